"""Combining maps: alignment checks, merges on the shared lattice, resampling, majority masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxelloom.lattice import IJK
from voxelloom.spark import per_map

METHODS = {
    "mean": lambda c: F.avg(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c),
    "sum": lambda c: F.sum(c), "median": lambda c: F.percentile(c, 0.5),
}
REFERENCES = ("first", "largest", "smallest")


def _method(name: str):
    if name not in METHODS:
        raise ValueError(f"unsupported combination method: {name!r}")
    return METHODS[name]


def merge_stored(maps: DataFrame, by: list[str], method: str, value: str = "agfe") -> DataFrame:
    """Aggregate the maps that store a voxel, with how many they are.

    One shuffle on the voxel; a voxel has one row per run, so each group is small.
    """
    return maps.groupBy(*by, *IJK).agg(_method(method)(value).alias(value),
                                       F.count(value).alias("n_maps"))


def merge_covered(maps: DataFrame, metas: DataFrame, by: list[str], method: str, fill: float = 0.0,
                  reference: str = "first", value: str = "agfe", map_id: str = "replica") -> DataFrame:
    """Merge over the maps that *cover* a voxel, onto the window of the reference map.

    A covering map that stores nothing at a voxel reads *background* (a column of *metas*
    next to `lo_i`, `n_i` and so on); a map that does not reach a voxel has no say.  Only
    voxels of the reference window that some map stores come out: all others are the same
    constant as the backgrounds, or *fill* where no map reaches.
    """
    fn = _method(method)
    ref = reference_map(metas, by, reference, map_id)
    stored = maps.select(*by, *IJK).distinct()
    stored = per_map(stored, ref.select(*by, *[c for a in IJK for c in (
        F.col(f"lo_{a}").alias(f"r_{a}"), F.col(f"n_{a}").alias(f"m_{a}"))]), by)
    stored = stored.filter(_inside("r", "m")).select(*by, *IJK)
    covering = per_map(stored, metas, by).filter(_inside("lo", "n")).select(*by, map_id, *IJK, "background")
    valued = covering.join(maps.select(*by, map_id, *IJK, value), [*by, map_id, *IJK], "left")
    return (valued.withColumn(value, F.coalesce(F.col(value), F.col("background")))
            .groupBy(*by, *IJK).agg(F.coalesce(fn(value), F.lit(float(fill))).alias(value),
                                    F.count(F.lit(1)).alias("n_cover")))


def _inside(lo: str, n: str) -> Column:
    cond = F.lit(True)
    for a in IJK:
        cond = cond & (F.col(a) >= F.col(f"{lo}_{a}")) & (F.col(a) < F.col(f"{lo}_{a}") + F.col(f"{n}_{a}"))
    return cond


def reference_map(metas: DataFrame, by: list[str], choice: str, map_id: str = "replica") -> DataFrame:
    """The map whose window the result takes: the first, or the one with most or fewest voxels."""
    if choice not in REFERENCES:
        raise ValueError(f"unknown reference {choice!r}; valid: {list(REFERENCES)}")
    size = F.col("n_i").cast("bigint") * F.col("n_j") * F.col("n_k")
    order = {"first": F.lit(0).cast("bigint"), "largest": -size, "smallest": size}[choice]
    names = [c for c in metas.columns if c not in by]
    best = metas.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct(order, F.col(map_id))).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in names])


def alignment(metas: DataFrame, by: list[str], map_id: str = "replica") -> DataFrame:
    """How each map meets the first one: ``aligned``, ``shifted`` by whole voxels, or ``resample``.

    *metas* holds origins ``ox oy oz``, one ``delta`` and the sizes, a row per map.
    """
    cols = ["ox", "oy", "oz", "delta", "n_i", "n_j", "n_k"]
    first = metas.groupBy(*by).agg(F.min_by(F.struct(map_id, *cols), map_id).alias("_f"))
    pairs = metas.join(first, by) if by else metas.join(F.broadcast(first), F.lit(True))
    ref = {c: F.col(f"_f.{c}") for c in cols}
    same = F.lit(True)
    for n in ("n_i", "n_j", "n_k"):
        same = same & (F.col(n) == ref[n])
    near = F.lit(0.1) * F.least(F.col("delta"), ref["delta"])
    whole = F.abs(F.col("delta") - ref["delta"]) <= F.lit(1e-3) * F.least(F.col("delta"), ref["delta"])
    for o, n in (("ox", "n_i"), ("oy", "n_j"), ("oz", "n_k")):
        low = F.col(o) - ref[o]
        high = low + F.col(n) * F.col("delta") - ref[n] * ref["delta"]
        same = same & (F.abs(low) <= near) & (F.abs(high) <= near)
        whole = whole & (F.abs(low / ref["delta"] - F.round(low / ref["delta"])) <= F.lit(1e-3))
    return pairs.select(
        *by, F.col(f"_f.{map_id}").alias("reference"), map_id,
        F.when(same, "aligned").when(whole, "shifted").otherwise("resample").alias("relation"))


def check_strict(metas: DataFrame, by: list[str], method: str, map_id: str = "replica") -> None:
    """Raise unless all maps to be merged share shape and place (one row reaches the driver)."""
    _method(method)
    bad = alignment(metas, by, map_id).filter(F.col("relation") != "aligned").limit(1).collect()
    if bad:
        raise ValueError(f"maps {bad[0]['reference']!r} and {bad[0][map_id]!r} are not aligned")


def resample_trilinear(source: DataFrame, by: list[str], shift: tuple[float, float, float],
                       window: dict, scale: float = 1.0, value: str = "agfe") -> DataFrame:
    """Trilinear resample onto a target window; outside the source reads 0.

    Target voxel ``t`` lies at source index ``t * scale + shift``.  The source spreads onto
    the targets it can touch (eight when the voxels are equal in size): each source voxel
    names them, weighs itself, and the weights meet in one sum on the target voxel.  A
    source voxel not stored reads 0, so it need not be there.
    """
    out = source.select(*by, *IJK, F.col(value).alias("_v"))
    weight = F.lit(1.0)
    for a, s in zip(IJK, shift):
        lo, hi = window[a]
        first = F.ceil((F.col(a) - F.lit(1.0) - F.lit(float(s))) / F.lit(float(scale))).cast("int")
        last = F.floor((F.col(a) + F.lit(1.0) - F.lit(float(s))) / F.lit(float(scale))).cast("int")
        first, last = F.greatest(first, F.lit(lo)), F.least(last, F.lit(hi - 1))
        out = (out.filter(first <= last)
               .withColumn(f"t_{a}", F.explode(F.sequence(first, last))))
        gap = F.abs(F.col(f"t_{a}") * F.lit(float(scale)) + F.lit(float(s)) - F.col(a))
        out = out.withColumn(f"w_{a}", F.lit(1.0) - gap).filter(F.col(f"w_{a}") > 0)
        weight = weight * F.col(f"w_{a}")
    return (out.groupBy(*by, *[F.col(f"t_{a}").alias(a) for a in IJK])
            .agg(F.sum(weight * F.col("_v")).alias(value)))


def source_span(column: str, axis: str, shift: float, window: dict, size: int,
                scale: float = 1.0) -> Column:
    """Whether a target index maps inside ``[0, size - 1]`` of the source."""
    at = F.col(axis) * F.lit(scale) + F.lit(shift)
    return (at >= 0) & (at <= size - 1)


def resample_nearest(mask: DataFrame, by: list[str], shift: tuple[float, float, float],
                     window: dict, scale: float = 1.0) -> DataFrame:
    """Nearest-voxel resample of a mask: targets whose rounded source voxel is set."""
    out = mask.select(*by, *IJK)
    for a, s in zip(IJK, shift):
        lo, hi = window[a]
        first = F.ceil((F.col(a) - F.lit(0.5) - F.lit(float(s))) / F.lit(float(scale))).cast("int")
        last = F.floor((F.col(a) + F.lit(0.5) - F.lit(float(s))) / F.lit(float(scale))).cast("int")
        first, last = F.greatest(first, F.lit(lo)), F.least(last, F.lit(hi - 1))
        out = out.filter(first <= last).withColumn(f"t_{a}", F.explode(F.sequence(first, last)))
        at = F.col(f"t_{a}") * F.lit(float(scale)) + F.lit(float(s))
        out = out.filter(F.floor(at + F.lit(0.5)) == F.col(a))
    return out.select(*by, *[F.col(f"t_{a}").alias(a) for a in IJK]).distinct()


def majority(masks: DataFrame, metas: DataFrame, by: list[str], min_fraction: float = 0.5,
             map_id: str = "replica") -> DataFrame:
    """Voxels set in at least *min_fraction* of the runs that cover them.

    Coverage is arithmetic on the run windows, which travel as one short array per owner.
    """
    seen = masks.groupBy(*by, *IJK).agg(F.count_distinct(map_id).alias("votes"))
    spans = [F.col(f"{p}_{a}") for p in ("lo", "n") for a in IJK]
    runs = metas.groupBy(*by).agg(F.collect_list(F.struct(*spans)).alias("_runs"))
    joined = per_map(seen, runs, by)

    def holds(run):
        cond = F.lit(True)
        for a in IJK:
            cond = cond & (F.col(a) >= run[f"lo_{a}"]) & (F.col(a) < run[f"lo_{a}"] + run[f"n_{a}"])
        return cond

    return (joined.withColumn("n_cover", F.size(F.filter("_runs", holds))).drop("_runs")
            .filter((F.col("n_cover") > 0) & (F.col("votes") >= F.lit(float(min_fraction)) * F.col("n_cover"))))
