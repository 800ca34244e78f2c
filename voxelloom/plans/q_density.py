"""Queries: scans, histograms, energies, smoothing, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import thermo
from voxelloom.functions.export import rounded
from voxelloom.lattice import in_window
from voxelloom.operators import density, energy, smoothing
from voxelloom.plans import fixture_maps as fx
from voxelloom.plans.registry import KT, query
from voxelloom.sources import tables as t

SIGMA = 0.9333
FLOOR = thermo.detection_floor(SIGMA)
W = thermo.pooled_voxels(SIGMA)


@query("positions_profile", ["positions"], """
SELECT probe, count(*) AS n_rows, CAST(count(DISTINCT frame) AS BIGINT) AS n_frames,
  round(avg(x), 6) + 0e0 AS mean_x, round(min(y), 6) + 0e0 AS min_y, round(max(z), 6) + 0e0 AS max_z
FROM positions GROUP BY probe""")
def positions_profile(spark, root):
    return t.positions(spark, root).groupBy("probe").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("frame").alias("n_frames"),
        rounded(F.avg("x"), 6).alias("mean_x"), rounded(F.min("y"), 6).alias("min_y"),
        rounded(F.max("z"), 6).alias("max_z"))


@query("strided_scan", ["positions"], """
SELECT probe, frame, count(*) AS n_rows FROM positions WHERE frame % 5 = 0 GROUP BY ALL""")
def strided_scan(spark, root):
    return density.stride(t.positions(spark, root), 5).groupBy("probe", "frame").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("atom_selection", ["positions"], """
SELECT probe, atype, count(*) AS n_rows, count(DISTINCT resid) AS n_residues
FROM positions WHERE probe IN ('BEN', 'IPA') AND NOT starts_with(atype, 'H') GROUP BY ALL""")
def atom_selection(spark, root):
    kept = t.positions(spark, root).filter(
        F.col("probe").isin("BEN", "IPA") & ~F.col("atype").startswith("H"))
    return kept.groupBy("probe", "atype").agg(F.count(F.lit(1)).alias("n_rows"),
                                              F.count_distinct("resid").alias("n_residues"))


@query("frames_box", ["frames"], """
SELECT replica, count(*) AS n_frames, round(avg(lx), 6) AS lx, round(avg(ly), 6) AS ly,
  round(avg(lz), 6) AS lz FROM frames GROUP BY replica""")
def frames_box(spark, root):
    return t.frames(spark, root).groupBy("replica").agg(
        F.count(F.lit(1)).alias("n_frames"),
        *[rounded(F.avg(c), 6).alias(c) for c in ("lx", "ly", "lz")])


@query("voxel_histogram", ["hist"], "SELECT probe, i, j, k, n FROM hist")
def voxel_histogram(spark, root):
    return fx.histogram(spark, root)


@query("typed_histogram", ["thist"], "SELECT probe, atype, i, j, k, n FROM thist")
def typed_histogram(spark, root):
    return fx.histogram(spark, root, ("probe", "atype"))


@query("typed_total_rollup", ["thist"], """
SELECT probe, coalesce(atype, 'total') AS atype, i, j, k, CAST(sum(n) AS BIGINT) AS n FROM thist
GROUP BY GROUPING SETS ((probe, atype, i, j, k), (probe, i, j, k))""")
def typed_total_rollup(spark, root):
    return density.typed_histograms(t.positions(spark, root), ["probe"], t.GRID)


@query("grid_extent", ["positions", "frames"], """
SELECT probe, replica,
  CAST(floor(least(0e0, lox - 2.5e0) / 2.5e0) AS INT) AS lo_i,
  CAST(ceil(greatest(lx, hix + 2.5e0) / 2.5e0) - floor(least(0e0, lox - 2.5e0) / 2.5e0) AS INT) AS n_i,
  CAST(floor(least(0e0, loy - 2.5e0) / 2.5e0) AS INT) AS lo_j,
  CAST(ceil(greatest(ly, hiy + 2.5e0) / 2.5e0) - floor(least(0e0, loy - 2.5e0) / 2.5e0) AS INT) AS n_j,
  CAST(floor(least(0e0, loz - 2.5e0) / 2.5e0) AS INT) AS lo_k,
  CAST(ceil(greatest(lz, hiz + 2.5e0) / 2.5e0) - floor(least(0e0, loz - 2.5e0) / 2.5e0) AS INT) AS n_k
FROM (SELECT probe, replica, min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy,
        min(z) AS loz, max(z) AS hiz FROM positions GROUP BY ALL),
  (SELECT avg(lx) AS lx, avg(ly) AS ly, avg(lz) AS lz FROM frames)""")
def grid_extent(spark, root):
    return density.extent(t.positions(spark, root), t.frames(spark, root), ["probe", "replica"], t.GRID)


@query("frac_outside_box", ["positions", "frames"], """
SELECT probe, round(avg(CASE WHEN x < 0 OR x > lx OR y < 0 OR y > ly OR z < 0 OR z > lz
  THEN 1e0 ELSE 0e0 END), 8) + 0e0 AS frac_outside
FROM positions, (SELECT avg(lx) - 1 AS lx, avg(ly) - 1 AS ly, avg(lz) - 1 AS lz FROM frames) GROUP BY probe""")
def frac_outside_box(spark, root):
    smaller = t.frames(spark, root).withColumns({c: F.col(c) - 1 for c in ("lx", "ly", "lz")})
    out = density.outside_box(t.positions(spark, root), smaller, ["probe"])
    return out.select("probe", rounded("frac_outside", 8).alias("frac_outside"))


@query("agfe_raw", ["agfe"], "SELECT probe, i, j, k, n, round(agfe, 6) + 0e0 AS agfe FROM agfe")
def agfe_raw(spark, root):
    return fx.raw(spark, root).select("probe", "i", "j", "k", "n", rounded("agfe", 6).alias("agfe"))


@query("agfe_typed", ["tagfe"], "SELECT probe, atype, i, j, k, round(agfe, 6) + 0e0 AS agfe FROM tagfe")
def agfe_typed(spark, root):
    return fx.raw(spark, root, ("probe", "atype")).select(
        "probe", "atype", "i", "j", "k", rounded("agfe", 6).alias("agfe"))


@query("agfe_display", ["agfe"], """
SELECT probe, i, j, k, CASE WHEN agfe >= 0 THEN 0e0 ELSE round(agfe, 6) END + 0e0 AS agfe FROM agfe""")
def agfe_display(spark, root):
    return fx.raw(spark, root).select("probe", "i", "j", "k",
                                      rounded(thermo.display("agfe"), 6).alias("agfe"))


@query("combined_min_map", ["tagfe"], """
SELECT probe, i, j, k, round(min(agfe), 6) + 0e0 AS agfe FROM tagfe GROUP BY ALL""")
def combined_min_map(spark, root):
    return energy.combine_types(fx.raw(spark, root, ("probe", "atype")), ["probe"]).select(
        "probe", "i", "j", "k", rounded("agfe", 6).alias("agfe"))


@query("favorable_summary", ["agfe"], f"""
SELECT probe, count(*) FILTER (agfe < -{KT}) AS n_favorable, round(min(agfe), 6) + 0e0 AS agfe_min,
  round(sum(n) / 50e0, 6) AS n_atoms, count(*) AS n_occupied FROM agfe GROUP BY probe""")
def favorable_summary(spark, root):
    return fx.raw(spark, root).groupBy("probe").agg(
        F.count_if(F.col("agfe") < F.lit(fx.CUTOFF)).alias("n_favorable"),
        rounded(F.min("agfe"), 6).alias("agfe_min"),
        rounded(F.sum("n") / F.lit(50.0), 6).alias("n_atoms"), F.count(F.lit(1)).alias("n_occupied"))


@query("density_zscore", ["hist"], """
SELECT probe, i, j, k, round((n - m) / sqrt(q / 8000e0 - m * m), 6) + 0e0 AS density
FROM hist JOIN (SELECT probe, sum(n) / 8000e0 AS m, sum(n * n) AS q FROM hist GROUP BY probe) USING (probe)""")
def density_zscore(spark, root):
    out = density.density_zscore(fx.histogram(spark, root), ["probe"], t.N_ACCESSIBLE)
    return out.select("probe", "i", "j", "k", rounded("density", 6).alias("density"))


_POOL = f"cast('{W!r}' as double)"


@query("sampling_report", ["tot"], f"""
SELECT probe, round(b, 6) AS bulk_counts_per_voxel, round(b * {_POOL}, 6) AS pooled_bulk_counts,
  round(-{KT} * ln(1 / b), 6) + 0e0 AS agfe_of_one_visit, round(b * exp(1e0), 6) AS counts_at_cutoff,
  round({KT} / sqrt(b * {_POOL}), 6) AS agfe_noise_sigma, round(f, 6) + 0e0 AS noise_floor_agfe,
  -{KT} > f AS cutoff_below_noise_floor
FROM (SELECT probe, b, -{KT} * ln((b * {_POOL}
    + sqrt(2e0 * ln(greatest(1e0, 8000e0 / {_POOL}))) * sqrt(b * {_POOL})) / {_POOL} / b) AS f
  FROM (SELECT probe, n_atoms * 50e0 / 8000e0 AS b FROM tot))""")
def sampling_report(spark, root):
    totals = density.atoms_per_map(fx.histogram(spark, root), ["probe"], t.FRAMES)
    out = energy.sampling_report(totals, t.FRAMES, t.N_ACCESSIBLE, SIGMA)
    cols = ["bulk_counts_per_voxel", "pooled_bulk_counts", "agfe_of_one_visit", "counts_at_cutoff",
            "agfe_noise_sigma", "noise_floor_agfe"]
    return out.select("probe", *[rounded(c, 6).alias(c) for c in cols], "cutoff_below_noise_floor")


def _passes(source: str, axis_order: str, dense: bool = False) -> str:
    """Oracle text of the three axis passes over a table (probe, i, j, k, v)."""
    weights = ", ".join(f"({d - len(smoothing.kernel(SIGMA)) // 2}, cast('{w!r}' as double))"
                        for d, w in enumerate(smoothing.kernel(SIGMA)))
    text, src = f"WITH taps(d, w) AS (VALUES {weights})", source
    for n, axis in enumerate(axis_order):
        moved = f"{axis} + d"
        if dense:
            m = f"((({axis} + d) % 40 + 40) % 40)"
            moved = f"CASE WHEN {m} < 20 THEN {m} ELSE 39 - {m} END"
        cols = ", ".join(f"CAST({moved} AS INT) AS {a}" if a == axis else a for a in "ijk")
        text += (f", p{n} AS (SELECT probe, i, j, k, sum(v) AS v FROM (SELECT probe, {cols}, v * w AS v "
                 f"FROM {src}, taps) WHERE {axis} BETWEEN 0 AND 19 GROUP BY ALL)")
        src = f"p{n}"
    return text


@query("gauss_smooth_counts", ["hist"], f"""
SELECT * FROM ({_passes("(SELECT probe, i, j, k, n::DOUBLE AS v FROM hist WHERE i < 20 AND j < 20 AND k < 20)", "kji")}
SELECT probe, i, j, k, round(v, 6) + 0e0 AS smooth FROM p2)""")
def gauss_smooth_counts(spark, root):
    out = smoothing.gaussian_counts(fx.histogram(spark, root), ["probe"], SIGMA, t.WINDOW)
    return out.select("probe", "i", "j", "k", rounded("smooth", 6).alias("smooth"))


@query("agfe_smoothed", ["hist", "tot"], f"""
SELECT probe, i, j, k, round(-{KT} * ln(greatest(v, cast('{FLOOR!r}' as double)) / 50e0
  / (n_atoms / 8000e0)), 6) + 0e0 AS agfe FROM (
{_passes("(SELECT probe, i, j, k, n::DOUBLE AS v FROM hist WHERE i < 20 AND j < 20 AND k < 20)", "kji")}
SELECT * FROM p2) JOIN tot USING (probe)""")
def agfe_smoothed(spark, root):
    out = energy.smoothed_map(fx.histogram(spark, root), ["probe"], t.FRAMES, t.N_ACCESSIBLE,
                              SIGMA, t.WINDOW)
    return out.select("probe", "i", "j", "k", rounded("agfe", 6).alias("agfe"))


@query("agfe_energy_smoothed", ["agfe", "tot"], f"""
SELECT probe, i, j, k, CASE WHEN v >= 0 THEN 0e0 ELSE round(v, 6) END + 0e0 AS agfe FROM (
{_passes('''(SELECT t.probe, a.i, b.j, c.k, coalesce(g.agfe, -cast('0.59616123' as double)
    * ln(1e-10 / (t.n_atoms / 8000e0))) AS v FROM tot t, (SELECT unnest(range(20))::INT AS i) a,
    (SELECT unnest(range(20))::INT AS j) b, (SELECT unnest(range(20))::INT AS k) c
    LEFT JOIN agfe g ON g.probe = t.probe AND g.i = a.i AND g.j = b.j AND g.k = c.k)''', "kji", True)}
SELECT * FROM p2)""")
def agfe_energy_smoothed(spark, root):
    maps = fx.raw(spark, root)
    totals = density.atoms_per_map(fx.histogram(spark, root), ["probe"], t.FRAMES)
    back = energy.background(totals, t.FRAMES, t.N_ACCESSIBLE).select("probe", "background")
    dense = (smoothing.dense_window(back, t.WINDOW)
             .join(maps.select("probe", "i", "j", "k", "agfe").filter(in_window(t.WINDOW)),
                   ["probe", "i", "j", "k"], "left")
             .withColumn("agfe", F.coalesce("agfe", "background")))
    out = smoothing.gaussian_field(dense, ["probe"], SIGMA, t.WINDOW)
    return out.select("probe", "i", "j", "k", rounded(thermo.display("smooth"), 6).alias("agfe"))


@query("energy_round_trip", ["agfe", "tot"], f"""
SELECT probe, i, j, k, round(n_atoms * 50e0 / 8000e0 * exp(-agfe / {KT}), 6) + 0e0 AS counts, n
FROM agfe JOIN tot USING (probe)""")
def energy_round_trip(spark, root):
    """Counts to energy and back."""
    out = fx.raw(spark, root).withColumn(
        "bulk", thermo.bulk_counts("n_atoms", float(t.FRAMES), float(t.N_ACCESSIBLE)))
    energies = thermo.agfe_of_counts("n", "bulk")
    return out.select("probe", "i", "j", "k",
                      rounded(thermo.counts_of_agfe(energies, "bulk"), 6).alias("counts"), "n")


@query("smoothed_background", ["tot"], f"""
SELECT probe, round(-{KT} * ln(cast('{FLOOR!r}' as double) / 50e0 / (n_atoms / 8000e0)), 6) + 0e0
  AS background FROM tot""")
def smoothed_background(spark, root):
    totals = density.atoms_per_map(fx.histogram(spark, root), ["probe"], t.FRAMES)
    out = energy.background(totals, t.FRAMES, t.N_ACCESSIBLE, floor_counts=FLOOR)
    return out.select("probe", rounded("background", 6).alias("background"))
