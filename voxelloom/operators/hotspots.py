"""Hotspots: clustered favourable voxels and their summary rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxelloom.functions import thermo
from voxelloom.lattice import IJK, centre, voxel_key
from voxelloom.operators import components, stencil
from voxelloom.spark import cut, kth, per_map, ranked


def cluster(voxels: DataFrame, by: list[str], strategy, **params) -> DataFrame:
    """Run a clustering strategy and bring the energies back to its labelled voxels.

    A strategy takes the voxels, the map columns and its parameters, and returns rows
    ``(by, i, j, k, label, n_voxels)``; any callable with that shape will do.  Favourable
    voxels and clusters are written out: all later stages start from them.
    """
    voxels = cut(voxels.select(*by, *IJK, "agfe"))
    labels = strategy(voxels, by, **params)
    return cut(labels.join(voxels, [*by, *IJK]))


def strategy(name: str, gridsize: float, min_volume: float = 20.0, **kwargs):
    """A clustering strategy by name, with the minimum volume turned into voxels."""
    from voxelloom.operators import watershed
    known = {"connected_components": (components.label, {"connectivity"}),
             "skimage_watershed": (watershed.label, {"h", "smoothing_sigma", "min_distance",
                                                     "watershed_mode"})}
    if name not in known:
        raise ValueError(f"unknown clustering strategy {name!r}; valid options: {sorted(known)}")
    fn, allowed = known[name]
    bad = set(kwargs) - allowed
    if bad:
        raise ValueError(f"unknown arguments for {name}: {sorted(bad)}")
    n = thermo.min_voxels(min_volume, gridsize)
    return lambda voxels, by: fn(voxels, by, min_voxels=n, **kwargs)


def clean_mask(mask: DataFrame, by: list[str], window: dict, min_size: int | None = None,
               hole_size: int | None = None, opening: float | None = None,
               closing: float | None = None) -> DataFrame:
    """Optional clean-up before clustering; a step without its parameter is left out."""
    out = mask.select(*by, *IJK)
    if min_size is not None:
        out = components.remove_small(out, by, min_size)
    if hole_size is not None:
        out = components.fill_holes(out, by, hole_size, window)
    if opening is not None:
        out = stencil.opening(out, by, opening, window)
    if closing is not None:
        out = stencil.closing(out, by, closing, window)
    return out


def top_percent(labelled: DataFrame, by: list[str], percent: float) -> DataFrame:
    """Mean of the most negative *percent* of each hotspot's voxels, at least one voxel."""
    key = [*by, "label"]
    keep = F.greatest(F.lit(1), F.floor(F.col("n_voxels") * F.lit(float(percent)) / F.lit(100.0)).cast("int"))
    want = cut(labelled.groupBy(*key).agg(F.max(keep).alias("_keep")))
    last = kth(labelled, key, "agfe", want.select(*key, (F.col("_keep") - 1).alias("k"))).withColumn("_keep", F.col("k") + 1)
    low = per_map(labelled.select(*key, "agfe"), last, key)
    below = F.coalesce(F.sum(F.when(F.col("agfe") < F.col("value"), F.col("agfe"))), F.lit(0.0))
    # equal values at the threshold count as often as places are left
    return (low.groupBy(*key, "_keep", "value", "less").agg(below.alias("_sum"))
            .select(*key, ((F.col("_sum") + F.col("value") * (F.col("_keep") - F.col("less"))) / F.col("_keep"))
                    .alias("agfe_mean_top_pct")))


def summarise(labelled: DataFrame, by: list[str], gridsize: float, top_pct: float = 10.0) -> DataFrame:
    """One row per hotspot, ranked by its deepest voxel within each map."""
    w = F.abs("agfe")
    rows = labelled.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n_voxels"), F.min("agfe").alias("agfe_min"),
        *[(F.sum(w * centre(a, gridsize)) / F.sum(w)).alias(f"centroid_{c}") for a, c in zip(IJK, "xyz")])
    rows = rows.join(top_percent(labelled, by, top_pct), [*by, "label"])
    return ranked(rows, by, ["agfe_min", "label"], name="rank")


def per_type(labelled: DataFrame, typed: DataFrame, by: list[str], cutoff: float,
             type_col: str = "atype") -> DataFrame:
    """Deepest energy per hotspot and atom type, for the types favourable anywhere in it."""
    return (labelled.select(*by, "label", *IJK)
            .join(typed.select(*by, type_col, *IJK, "agfe"), [*by, *IJK])
            .groupBy(*by, "label", type_col).agg(F.min("agfe").alias("agfe_type"))
            .filter(F.col("agfe_type") < F.lit(float(cutoff))))


def favourable_types(typed_min: DataFrame, by: list[str], type_col: str = "atype") -> DataFrame:
    """Sorted type names and a type-to-energy map per hotspot (as many entries as types)."""
    return typed_min.groupBy(*by, "label").agg(
        F.sort_array(F.collect_set(type_col)).alias("favorable_atomtypes"),
        F.map_from_entries(F.collect_list(F.struct(F.col(type_col), F.col("agfe_type")))).alias("per_type_agfe"))


def largest_share(labelled: DataFrame, favourable: DataFrame, by: list[str]) -> DataFrame:
    """Largest cluster against all favourable voxels; over half hints at a loose cutoff."""
    big = (labelled.select(*by, "label", "n_voxels").distinct().groupBy(*by)
           .agg(F.max("n_voxels").alias("largest")))
    total = favourable.groupBy(*by).agg(F.count(F.lit(1)).alias("n_favorable"))
    return (big.join(total, by)
            .withColumn("degenerate", F.col("largest") > F.lit(0.5) * F.col("n_favorable")))


def shape_filter(rows: DataFrame, max_solidity: float | None = None,
                 min_sharpness: float | None = None) -> DataFrame:
    """Drop convex or diffuse hotspots; a missing or non-finite property never drops one."""
    out = rows
    if max_solidity is not None:
        v = F.col("geom_solidity")
        out = out.filter(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
                         | (v <= F.lit(float(max_solidity))))
    if min_sharpness is not None:
        v = F.col("field_sharpness")
        out = out.filter(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
                         | (v >= F.lit(float(min_sharpness))))
    return out


def rank_map(labelled: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Hotspot rank per voxel; voxels not stored read 0."""
    return labelled.select(*by, *IJK, "label").join(rows.select(*by, "label", "rank"), [*by, "label"]) \
        .select(*by, *IJK, "rank")


def carve_radius(labelled: DataFrame, by: list[str], gridsize: float) -> DataFrame:
    """Half the bounding-box diagonal and 2 A more."""
    sq = F.lit(0.0)
    for a in IJK:
        edge = (F.max(a) - F.min(a) + F.lit(1)) * F.lit(float(gridsize))
        sq = sq + edge * edge
    return labelled.groupBy(*by, "label").agg((F.lit(0.5) * F.sqrt(sq) + F.lit(2.0)).alias("carve_radius"))


def without_prefix(df: DataFrame, prefix: str = "geom_") -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith(prefix)])


def only_prefix(df: DataFrame, keys: list[str], prefix: str = "geom_") -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c.startswith(prefix)])


def sample_voxels(labelled: DataFrame, by: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most *most* voxels per hotspot, without replacement and the same every time.

    Row-number filters with a constant bound prune per task before the shuffle.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*by, "label").orderBy(F.xxhash64(voxel_key(), F.lit(seed)), voxel_key())
    return labelled.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
