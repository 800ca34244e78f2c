"""All registered queries; importing the modules registers them."""

from voxelloom.plans import (q_density, q_masks, q_merge, q_hotspots, q_sites,  # noqa: F401
                              q_kinetics, q_structure, q_io)
from voxelloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
