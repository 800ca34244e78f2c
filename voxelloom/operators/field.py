"""Descriptors read from a map around points: depth, contrast, sharpness, enclosure."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from voxelloom.lattice import IJK, centre, explode_ball, in_window, voxel_index

# Radii in A.
MIN_BALL = 3.0
SHELL_END = 5.0
CORE = 1.5
RING = (2.0, 3.0)
ENCLOSURE_RADIUS = 16.0

DESCRIPTORS = ("field_min_ball", "field_mean_ball", "field_contrast", "field_sharpness")


def _around(points: DataFrame, gridsize: float, radius: float, window: dict) -> DataFrame:
    """Voxels of the window within *radius* of each point, with their distance ``dist``.

    Points outside the window give no rows.
    """
    reach = math.ceil(radius / gridsize)
    home = points.withColumns({f"c_{a}": voxel_index(c, gridsize) for a, c in zip(IJK, "xyz")})
    inside = F.lit(True)
    for a in IJK:
        lo, hi = window[a]
        inside = inside & (F.col(f"c_{a}") >= lo) & (F.col(f"c_{a}") < hi)
    home = home.filter(inside)
    # A centre may sit half a voxel off its own voxel on each axis; the cube keeps all in reach.
    out = explode_ball(home, reach, min(3.0 * reach * reach, (radius / gridsize + math.sqrt(3) / 2) ** 2))
    out = out.withColumns({a: (F.col(f"c_{a}") + F.col(f"d{a}")).cast("int") for a in IJK})
    sq = F.lit(0.0)
    for a, c in zip(IJK, "xyz"):
        gap = centre(a, gridsize) - F.col(c)
        sq = sq + gap * gap
    return (out.withColumn("dist", F.sqrt(sq)).filter((F.col("dist") <= F.lit(radius)) & in_window(window))
            .drop("di", "dj", "dk", *[f"c_{a}" for a in IJK]))


def descriptors(points: DataFrame, maps: DataFrame, keys: list[str], map_keys: list[str],
                gridsize: float, window: dict, background: float | str = 0.0,
                value: str = "agfe") -> DataFrame:
    """Field descriptors per point.

    Every voxel of the ball inside the window counts; one that is not stored reads
    *background*.  The ball is spelled out as lattice offsets, so the match with the map is
    an equality of voxels.  A point off the grid, or an empty ring, gives NULL.
    """
    near = _around(points, gridsize, SHELL_END, window)
    bg = F.col(background) if isinstance(background, str) else F.lit(float(background))
    v = F.coalesce(F.col(value), bg)
    d = F.col("dist")
    joined = near.join(maps.select(*map_keys, *IJK, value), [*map_keys, *IJK], "left")

    def over(cond: Column, fn):
        return fn(F.when(cond, v))

    inner = over(d <= MIN_BALL, F.min)
    got = joined.groupBy(*keys).agg(
        inner.alias("field_min_ball"), over(d <= MIN_BALL, F.avg).alias("field_mean_ball"),
        (inner - over(d > MIN_BALL, F.avg)).alias("field_contrast"),
        ((over((d > RING[0]) & (d <= RING[1]), F.avg) - over(d <= CORE, F.min))
         / F.lit(CORE * CORE)).alias("field_sharpness"))
    return points.select(*keys).join(got, keys, "left")


def accessible_fraction(points: DataFrame, mask: DataFrame, keys: list[str], gridsize: float,
                        window: dict, radius: float = ENCLOSURE_RADIUS) -> DataFrame:
    """Share of the in-window voxels within *radius* of each point's voxel that the mask holds.

    The mask is folded into lattice columns first, and a ball meets a column once, with
    the k-range it cuts out of it.  That is one row per column instead of one per voxel of
    the ball; a column is no longer than the lattice is high.
    """
    reach = math.ceil(radius / gridsize)
    sq = (radius / gridsize) ** 2
    lo_k, hi_k = window["k"]
    home = points.withColumns({f"c_{a}": voxel_index(c, gridsize) for a, c in zip(IJK, "xyz")})
    cols = home.withColumn("di", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    cols = cols.filter(F.col("di") * F.col("di") <= F.lit(sq + 1e-9))
    half = F.floor(F.sqrt(F.lit(sq + 1e-9) - F.col("di") * F.col("di"))).cast("int")
    cols = cols.withColumn("dj", F.explode(F.sequence(-half, half)))
    span = F.floor(F.sqrt(F.greatest(F.lit(0.0), F.lit(sq + 1e-9) - F.col("di") * F.col("di")
                                     - F.col("dj") * F.col("dj")))).cast("int")
    cols = cols.select(*keys, (F.col("c_i") + F.col("di")).cast("int").alias("i"),
                       (F.col("c_j") + F.col("dj")).cast("int").alias("j"),
                       F.greatest(F.col("c_k") - span, F.lit(lo_k)).alias("k0"),
                       F.least(F.col("c_k") + span, F.lit(hi_k - 1)).alias("k1"))
    for a in ("i", "j"):
        lo, hi = window[a]
        cols = cols.filter((F.col(a) >= lo) & (F.col(a) < hi))
    cols = cols.filter(F.col("k0") <= F.col("k1"))
    held = mask.groupBy("i", "j").agg(F.collect_list("k").alias("ks"))
    hit = F.size(F.filter("ks", lambda k: (k >= F.col("k0")) & (k <= F.col("k1"))))
    got = (cols.join(held, ["i", "j"], "left").groupBy(*keys)
           .agg((F.sum(F.coalesce(F.greatest(hit, F.lit(0)), F.lit(0)))
                 / F.sum(F.col("k1") - F.col("k0") + F.lit(1))).alias("accessible_fraction")))
    return points.select(*keys).join(got, keys, "left")


# Descriptor, the site feature it becomes, and its sign (more negative is better).
FUSED = (("field_min_ball", "fused_affinity", -1.0), ("field_contrast", "fused_contrast", -1.0),
         ("field_sharpness", "fused_sharpness", 1.0))


def fused(sampled: DataFrame, site: str, probe: str) -> DataFrame:
    """Sum over probes of each probe's z-score across sites.

    *sampled* has a row per site and probe.  The moments of a probe come from an aggregate
    joined back, not from a window over all its sites.
    """
    oriented = sampled.select(site, probe, *[(F.col(d) * F.lit(s)).alias(n) for d, n, s in FUSED])
    stats = oriented.groupBy(probe).agg(*[c for _, n, _ in FUSED for c in (
        F.avg(n).alias(f"_m_{n}"), F.stddev_pop(n).alias(f"_s_{n}"), F.count(n).alias(f"_c_{n}"))])
    z = {}
    for _, n, _ in FUSED:
        usable = (F.col(f"_c_{n}") >= 2) & (F.col(f"_s_{n}") > 0)
        z[n] = F.when(usable, F.coalesce((F.col(n) - F.col(f"_m_{n}")) / F.col(f"_s_{n}"),
                                         F.lit(0.0))).otherwise(F.lit(0.0))
    return (oriented.join(stats, probe).groupBy(site)
            .agg(*[F.sum(z[n]).alias(n) for _, n, _ in FUSED]))


def panel_points(sites: DataFrame, panel: DataFrame, probe: str = "probe") -> DataFrame:
    """Each site once per probe of the panel; the panel is a short list of names."""
    names = panel.agg(F.sort_array(F.collect_set(probe)).alias("_p")).scalar()
    return sites.withColumn(probe, F.explode(names))
