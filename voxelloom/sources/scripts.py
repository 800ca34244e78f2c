"""Viewer scripts as text lines; nothing here needs a viewer."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F


def _point(owner: Column, number: Column, value: Column) -> Column:
    """A named point with a number and a value to colour it by."""
    return F.format_string("pseudoatom %s, name=P%d, resi=%d, b=%.3f, pos=[%.3f, %.3f, %.3f]", owner, number, number,
                           value, *[F.col(f"centroid_{c}") for c in "xyz"])


def session_lines(hotspots: DataFrame, sites: DataFrame, members: DataFrame, reference: str | None = None,
                  top_n: int = 0) -> DataFrame:
    """``(part, probe, rank, line)`` of a viewer session; order the lines by the first three columns.

    One object per probe holds its hotspots as points coloured by energy, one object ``sites`` the sites
    coloured by score, and a selection per site names the hotspots of its probes within its carve
    radius.  Everything is in the lines themselves: no map file is needed.
    """
    spark = hotspots.sparkSession
    owner = F.concat(F.lit("hot_"), F.col("probe"))
    kept = sites if not top_n else sites.filter(F.col("rank") <= F.lit(int(top_n)))
    number = F.col("rank").cast("int")
    points = hotspots.select(F.lit(1).alias("part"), "probe", number.alias("rank"), _point(owner, number, F.col("agfe_min")).alias("line"))
    looks = hotspots.select("probe").distinct().select(
        F.lit(2).alias("part"), "probe", F.lit(0).alias("rank"),
        F.format_string("as spheres, %s\nspectrum b, blue_white_red, %s", owner, owner).alias("line"))
    tops = kept.select(F.lit(3).alias("part"), F.lit("").alias("probe"), number.alias("rank"),
                       _point(F.lit("sites"), number, F.col("combined")).alias("line"))
    own = members.select("site_id", F.concat(F.lit("hot_"), F.col("probe")).alias("o")).distinct().groupBy("site_id").agg(
        F.array_join(F.sort_array(F.collect_set("o")), " or ").alias("owners"))
    chosen = own.join(kept.select("site_id", "rank", "carve_radius"), "site_id").select(
        F.lit(4).alias("part"), F.lit("").alias("probe"), number.alias("rank"),
        F.format_string("select site_%d, (%s) within %.2f of (sites and resi %d)", number, F.col("owners"), F.col("carve_radius"),
                        number).alias("line"))
    fixed = [(5, "", 0, "label sites, resi\ndeselect")]
    if reference:
        fixed.append((0, "", 0, f"load {os.path.abspath(reference)}"))
    out = spark.createDataFrame(fixed, "part int, probe string, rank int, line string")
    for more in (points, looks, tops, chosen):
        out = out.unionByName(more)
    return out


def contour_levels(maps: DataFrame, by: list[str], n_voxels: int, value: str = "agfe") -> DataFrame:
    """Level to draw each map at: the 0.1 % quantile of the dense map when nothing is above 0,
    else the 99.9 % one.  Voxels not stored enter as zeros by their number."""
    from voxelloom.spark import quantile
    top = maps.groupBy(*by).agg(F.max(value).alias("_max"), F.count(F.lit(1)).alias("_n"))
    rows = maps.select(*by, F.col(value).alias("v"), F.lit(1).cast("bigint").alias("w")).unionByName(
        top.select(*by, F.lit(0.0).alias("v"), (F.lit(n_voxels) - F.col("_n")).alias("w")).filter("w > 0"))
    low = quantile(rows, by, "v", 0.001, "w", "low")
    high = quantile(rows, by, "v", 0.999, "w", "high")
    return (top.join(low, by).join(high, by)
            .select(*by, F.when(F.col("_max") <= 0, F.col("low")).otherwise(F.col("high")).alias("level")))


def cluster_points(labelled: DataFrame, rows: DataFrame, gridsize: float, top_n: int = 10,
                   most: int | None = None) -> DataFrame:
    """Points of a 3-D figure: the best clusters in A, thinned to *most* per cluster if that is given."""
    from voxelloom.lattice import IJK, centre
    from voxelloom.operators.hotspots import sample_voxels
    best = rows.filter(F.col("rank") <= F.lit(int(top_n))).select("probe", "label", "rank")
    points = labelled.join(best, ["probe", "label"])
    return (points if most is None else sample_voxels(points, ["probe"], most)).select(
        "probe", "rank", "label", *[centre(a, gridsize).alias(c) for a, c in zip(IJK, "xyz")], "agfe")
