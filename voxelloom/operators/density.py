"""Occupancy histograms, grid extents and density scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxelloom.lattice import IJK, with_voxel, voxel_index
from voxelloom.spark import per_map


def stride(df: DataFrame, step: int, frame: str = "frame") -> DataFrame:
    """Every *step*-th frame; the predicate is on a plain column, so a scan can use it."""
    return df.filter(F.col(frame) % F.lit(int(max(1, step))) == 0)


def histogram(positions: DataFrame, by: list[str], gridsize: float) -> DataFrame:
    """Counts per map and voxel.  Partial counts per task, then one shuffle on the voxel:
    a voxel that holds a third of all rows is one row per task when it moves."""
    return (with_voxel(positions, gridsize).groupBy(*by, *IJK)
            .agg(F.count(F.lit(1)).alias("n")))


def typed_histograms(positions: DataFrame, by: list[str], gridsize: float,
                     type_col: str = "atype", total: str = "total") -> DataFrame:
    """Histogram per atom type and their sum (type ``total``) from one pass over the atoms.

    The total is summed from the typed counts, not from the atoms, so the atoms are not
    expanded into one copy per grouping level.
    """
    typed = histogram(positions, by + [type_col], gridsize)
    whole = (typed.groupBy(*by, *IJK).agg(F.sum("n").alias("n"))
             .withColumn(type_col, F.lit(total)))
    return typed.unionByName(whole)


def mean_box(frames: DataFrame, by: list[str] = ()) -> DataFrame:
    """Corners ``b0x .. b1z`` of the mean box: mean edges about the mean centre.

    Without centres ``cx cy cz`` the box starts at the origin.
    """
    cols = []
    for c in "xyz":
        half = F.avg(f"l{c}") / F.lit(2.0)
        mid = F.avg(f"c{c}") if f"c{c}" in frames.columns else half
        cols += [(mid - half).alias(f"b0{c}"), (mid + half).alias(f"b1{c}")]
    return frames.groupBy(*by).agg(*cols)


def _with_box(df: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    return per_map(df, mean_box(frames, keys), keys)


def extent(positions: DataFrame, frames: DataFrame, by: list[str], gridsize: float,
           box_by: list[str] = ()) -> DataFrame:
    """Lattice window per map: the mean box, widened by what was seen and one voxel.

    Edges snap outward, so windows differ by whole voxels only.
    """
    seen = positions.groupBy(*by).agg(
        *[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    return extent_of(seen, frames, by, gridsize, box_by)


def extent_of(seen: DataFrame, frames: DataFrame, by: list[str], gridsize: float, box_by: list[str] = ()) -> DataFrame:
    """The same from the spans ``lox .. hiz`` of each map."""
    gs = F.lit(float(gridsize))
    joined = _with_box(seen, frames, list(box_by))
    out = {}
    for a, i in zip("xyz", IJK):
        lo = F.floor(F.least(F.col(f"b0{a}"), F.col(f"lo{a}") - gs) / gs)
        hi = F.ceil(F.greatest(F.col(f"b1{a}"), F.col(f"hi{a}") + gs) / gs)
        out[f"lo_{i}"] = lo.cast("int")
        out[f"n_{i}"] = F.greatest(F.lit(1), (hi - lo)).cast("int")
    return joined.select(*by, *[c.alias(n) for n, c in out.items()])


def whole_window(extents: DataFrame) -> dict:
    """The window that holds all maps (one row reaches the driver)."""
    r = extents.agg(*[c for a in IJK for c in (F.min(f"lo_{a}").alias(f"lo_{a}"),
                                               F.max(F.col(f"lo_{a}") + F.col(f"n_{a}")).alias(f"hi_{a}"))]).first()
    return {a: (r[f"lo_{a}"], r[f"hi_{a}"]) for a in IJK}


def outside_box(positions: DataFrame, frames: DataFrame, by: list[str], box_by: list[str] = ()) -> DataFrame:
    """Share of positions beyond the mean box on any axis."""
    beyond = F.lit(False)
    for a in "xyz":
        beyond = beyond | (F.col(a) < F.col(f"b0{a}")) | (F.col(a) > F.col(f"b1{a}"))
    return (_with_box(positions, frames, list(box_by)).groupBy(*by)
            .agg(F.avg(beyond.cast("double")).alias("frac_outside")))


def density_zscore(hist: DataFrame, by: list[str], n_voxels: int, count: str = "n") -> DataFrame:
    """(count - mean) / population deviation over the whole window.

    Voxels nobody visited are not stored; they enter the moments through *n_voxels*.
    """
    moments = hist.groupBy(*by).agg(F.sum(count).cast("double").alias("_s"),
                                    F.sum(F.col(count) * F.col(count)).cast("double").alias("_q"))
    mean = F.col("_s") / F.lit(float(n_voxels))
    sd = F.sqrt(F.col("_q") / F.lit(float(n_voxels)) - mean * mean)
    return (per_map(hist, moments, by).withColumn("density", F.try_divide(F.col(count) - mean, sd))
            .drop("_s", "_q"))


def atoms_per_map(hist: DataFrame, by: list[str], n_frames: int) -> DataFrame:
    """Atoms per frame of each map, from its counts."""
    return hist.groupBy(*by).agg((F.sum("n") / F.lit(float(n_frames))).alias("n_atoms"),
                                 F.sum("n").alias("n_positions"))


def position_voxels(positions: DataFrame, gridsize: float) -> DataFrame:
    """Distinct voxels any position fell into."""
    return positions.select(*[voxel_index(c, gridsize).alias(a)
                              for a, c in zip(IJK, "xyz")]).distinct()
