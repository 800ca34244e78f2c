"""Residues lining a hotspot, and which molecules touched them when."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from voxelloom.lattice import IJK, centre, explode_ball, voxel_index
from voxelloom.operators import pairs
from voxelloom.operators.density import stride


def pocket_residues(labelled: DataFrame, atoms: DataFrame, by: list[str], gridsize: float,
                    cutoff: float = 4.5, residue=("resid", "resname", "chain")) -> DataFrame:
    """Residues with an atom within *cutoff* of a hotspot voxel.

    Every atom is put on the voxels its ball covers, so atoms and hotspots meet by voxel
    equality; atoms far from all hotspots are dropped first by coarse cells.
    """
    step = max(1, math.ceil(cutoff / gridsize) + 1)
    coarse = lambda a: F.floor(F.col(a) / F.lit(step)).cast("int")
    near = labelled.select(*[coarse(a).alias(f"q{a}") for a in IJK]).distinct()
    for a in IJK:
        near = near.withColumn(f"q{a}", F.explode(F.sequence(F.col(f"q{a}") - 1, F.col(f"q{a}") + 1)))
    near = near.distinct()
    placed = atoms.select(*residue, "x", "y", "z").distinct().withColumns(
        {f"c_{a}": voxel_index(c, gridsize) for a, c in zip(IJK, "xyz")})
    placed = placed.withColumns({f"q{a}": F.floor(F.col(f"c_{a}") / F.lit(step)).cast("int") for a in IJK})
    placed = placed.join(near, [f"q{a}" for a in IJK], "left_semi")
    reach = math.ceil(cutoff / gridsize)
    ball = explode_ball(placed, reach, min(3.0 * reach * reach, (cutoff / gridsize + math.sqrt(3) / 2) ** 2))
    ball = ball.withColumns({a: (F.col(f"c_{a}") + F.col(f"d{a}")).cast("int") for a in IJK})
    sq = F.lit(0.0)
    for a, c in zip(IJK, "xyz"):
        gap = centre(a, gridsize) - F.col(c)
        sq = sq + gap * gap
    ball = ball.withColumn("dist", F.sqrt(sq)).filter(F.col("dist") <= F.lit(float(cutoff)))
    met = ball.groupBy(*residue, *IJK).agg(F.min("dist").alias("dist"))     # one row per residue and voxel
    size = labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("n_voxels"))
    out = (met.join(labelled.select(*by, *IJK), list(IJK)).groupBy(*by, *residue)
           .agg(F.count(F.lit(1)).alias("n_contact_voxels"), F.min("dist").alias("min_dist")))
    return out.join(size, by).withColumn("contact_fraction", F.col("n_contact_voxels") / F.col("n_voxels"))


def contacts(molecules: DataFrame, residues: DataFrame, keys: list[str], cutoff: float = 4.0,
             step: int = 1, mol: str = "mol", resid: str = "resid") -> DataFrame:
    """Distinct ``(keys, mol, resid)`` in contact; *keys* hold the frame, every *step*-th is read."""
    return pairs.touching(stride(molecules, step), stride(residues, step), keys, mol, resid, cutoff)


def contact_summary(found: DataFrame, by: list[str], mol: str = "mol", frame: str = "frame") -> DataFrame:
    """Per residue and probe: contact events, frames with any contact, and molecules seen."""
    return found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_contact_events"), F.count_distinct(frame).alias("n_contact_frames"),
        F.count_distinct(mol).alias("n_contact_mols"),
        F.sort_array(F.collect_set(frame)).alias("contact_frames"))


def fused_residues(atoms: DataFrame, resid: str = "resid") -> DataFrame:
    """Residues with more atoms than the usual residue (the smaller count on a tie)."""
    sizes = atoms.groupBy(resid).agg(F.count(F.lit(1)).alias("n_atoms"))
    usual = sizes.groupBy("n_atoms").agg(F.count(F.lit(1)).alias("_f"))
    usual = usual.agg(F.max_by("n_atoms", F.struct("_f", -F.col("n_atoms"))).alias("_m"), F.sum("_f").alias("_k"))
    return (sizes.join(F.broadcast(usual), (F.col("n_atoms") > F.col("_m")) & (F.col("_k") >= 2))
            .select(resid, "n_atoms"))


def attach(residues: DataFrame, values: DataFrame, key: str = "resid") -> DataFrame:
    """Left join of per-residue values (fluctuation, embedding); Spark picks the strategy by size."""
    return residues.join(values, key, "left")


def unmatched(residues: DataFrame, values: DataFrame, key: str = "resid") -> DataFrame:
    """Values whose residue is not among those listed."""
    return values.join(residues, key, "left_anti")
