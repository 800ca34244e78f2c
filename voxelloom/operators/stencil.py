"""Mask algebra and morphology on voxel sets.  A mask is the set of its rows (owner, i, j, k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxelloom.lattice import IJK, ball_offsets, in_window, neighbour_offsets, shift_each

CROSS = [(0, 0, 0)] + neighbour_offsets(6)
from voxelloom.spark import per_map


def _voxels(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, *IJK)


def union(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return _voxels(a, by).unionByName(_voxels(b, by)).distinct()


def intersect(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return _voxels(a, by).intersect(_voxels(b, by))


def difference(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return _voxels(a, by).join(_voxels(b, by), [*by, *IJK], "left_anti")


def dilate(mask: DataFrame, by: list[str], offsets=None, iterations: int = 1,
           window: dict | None = None) -> DataFrame:
    """Union of the mask shifted by every offset (the face cross by default).

    *iterations* crosses in a row reach exactly the offsets with |di|+|dj|+|dk| <= iterations,
    so they run as one explode and one distinct instead of one shuffle per round.  A window
    clips the same either way: a shortest path between two voxels of a box stays in it.
    """
    if offsets is None:
        n = int(iterations)
        offsets = [(a, b, c) for a in range(-n, n + 1) for b in range(-n, n + 1)
                   for c in range(-n, n + 1) if abs(a) + abs(b) + abs(c) <= n]
    out = shift_each(_voxels(mask, by), offsets)
    if window is not None:
        out = out.filter(in_window(window))
    return out.distinct()


def erode(mask: DataFrame, by: list[str], offsets, window: dict | None = None) -> DataFrame:
    """Voxels whose whole footprint lies in the mask.

    Each mask voxel votes for the places it supports; a place needs as many votes as the
    footprint has voxels.  Beyond *window* counts as mask (the border does not erode).
    """
    votes = shift_each(_voxels(mask, by).distinct(), [(-a, -b, -c) for a, b, c in offsets])
    need = F.lit(len(offsets))
    if window is not None:
        votes = votes.filter(in_window(window))
        outside = F.lit(0)
        for a, b, c in offsets:
            inside = F.lit(True)
            for axis, d in zip(IJK, (a, b, c)):
                lo, hi = window[axis]
                inside = inside & (F.col(axis) + F.lit(d) >= F.lit(lo)) & (F.col(axis) + F.lit(d) < F.lit(hi))
            outside = outside + F.when(inside, F.lit(0)).otherwise(F.lit(1))
        need = need - outside
    counted = votes.groupBy(*by, *IJK).agg(F.count(F.lit(1)).alias("_votes"))
    return counted.filter(F.col("_votes") == need).select(*by, *IJK)


def opening(mask: DataFrame, by: list[str], radius: float, window: dict | None = None) -> DataFrame:
    ball = ball_offsets(radius)
    return dilate(erode(mask, by, ball, window), by, ball, window=window)


def closing(mask: DataFrame, by: list[str], radius: float, window: dict | None = None) -> DataFrame:
    ball = ball_offsets(radius)
    return erode(dilate(mask, by, ball, window=window), by, ball, window)


def accessible(solvent: DataFrame, protein: DataFrame, by: list[str], gridsize: float,
               window: dict, probe_radius: float = 1.4) -> DataFrame:
    """Voxels solvent was seen in, grown by the probe radius, minus those protein was seen in.

    *solvent* and *protein* are voxel tables; protein may lack the owner columns, it then
    counts for every owner.
    """
    grown = dilate(solvent, by, iterations=max(1, int(round(probe_radius / gridsize))), window=window)
    on = [c for c in by if c in protein.columns] + list(IJK)
    return grown.join(protein.select(*on).distinct(), on, "left_anti")


def accessible_count(mask: DataFrame, protein: DataFrame, by: list[str], gridsize: float,
                     window: dict, boxes: DataFrame) -> DataFrame:
    """Accessible voxels whose centre is in the box, at most the box volume less the protein's.

    *boxes* has the corners ``b0x .. b1z``, per run if it has run columns, else one row.
    """
    keys = [c for c in by if c in boxes.columns]
    inside, volume = F.lit(True), F.lit(1.0)
    for axis, c in zip(IJK, "xyz"):
        mid = (F.col(axis) + F.lit(0.5)) * F.lit(float(gridsize))
        inside = inside & (mid >= F.col(f"b0{c}") - 1e-9) & (mid <= F.col(f"b1{c}") + 1e-9)
        volume = volume * ((F.col(f"b1{c}") - F.col(f"b0{c}")) / F.lit(float(gridsize)))
    pkeys = [c for c in keys if c in protein.columns]
    blocked = (protein.filter(in_window(window)).groupBy(*pkeys)
               .agg(F.count_distinct(*IJK).alias("_blocked")))
    size = boxes.withColumn("_box", F.bround(volume).cast("bigint"))
    size = size.join(blocked, pkeys, "left") if pkeys else size.join(F.broadcast(blocked), F.lit(True), "left")
    size = size.withColumn("cap", F.greatest(F.lit(1).cast("bigint"), F.col("_box") - F.coalesce("_blocked", F.lit(0))))
    joined = per_map(mask, size, keys)
    return (joined.filter(inside).groupBy(*by).agg(F.count(F.lit(1)).alias("n_seen"), F.first("cap").alias("cap"))
            .withColumn("n_accessible", F.least("n_seen", "cap")))
