"""Maps, masks and hotspots of the fixture views, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelloom.functions import thermo
from voxelloom.operators import components, density, energy
from voxelloom.sources import tables as t
from voxelloom.spark import cut

CUTOFF = thermo.cutoff(1.0)
MIN_VOXELS = 8


def histogram(spark: SparkSession, root: str, by=("probe",)) -> DataFrame:
    """Written once: totals and voxels both start from the counts, not from the positions."""
    return cut(density.histogram(t.positions(spark, root), list(by), t.GRID))


def raw(spark: SparkSession, root: str, by=("probe",)) -> DataFrame:
    return energy.raw_map(histogram(spark, root, by), list(by), t.FRAMES, t.N_ACCESSIBLE)


def favourable(spark: SparkSession, root: str) -> DataFrame:
    return raw(spark, root).filter(F.col("agfe") < F.lit(CUTOFF))


def labelled(spark: SparkSession, root: str, connectivity: int = 26,
             min_voxels: int = MIN_VOXELS) -> DataFrame:
    """Favourable voxels with energy, component label and component size."""
    from voxelloom.operators.hotspots import cluster
    return cluster(favourable(spark, root).select("probe", "i", "j", "k", "agfe"), ["probe"],
                   components.label, min_voxels=min_voxels, connectivity=connectivity)
