"""Free-energy maps from histograms: raw, smoothed and as displayed; sampling reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxelloom.functions import thermo
from voxelloom.lattice import IJK
from voxelloom.operators import smoothing
from voxelloom.spark import per_map


def totals(hist: DataFrame, by: list[str], n_frames, n_accessible) -> DataFrame:
    """Atoms per frame, frames and accessible voxels of each map.

    *n_frames* and *n_accessible* are numbers, or tables of them by some of the map columns.
    """
    out = hist.groupBy(*by).agg(F.sum("n").alias("n_positions"))
    for name, given in (("n_frames", n_frames), ("n_accessible", n_accessible)):
        if isinstance(given, DataFrame):
            out = out.join(given, [c for c in by if c in given.columns])
        else:
            out = out.withColumn(name, F.lit(float(given)))
    return out.withColumn("n_atoms", F.col("n_positions") / F.col("n_frames"))


def _inverted(counts: DataFrame, sizes: DataFrame, by: list[str], column: str, temperature: float,
              floor_counts: float | None) -> DataFrame:
    joined = per_map(counts, sizes.select(*by, "n_atoms", "n_frames", "n_accessible"), by)
    return (joined.withColumn("agfe", thermo.agfe(column, "n_atoms", "n_frames", "n_accessible",
                                                  temperature, floor_counts))
            .drop("n_frames", "n_accessible"))


def raw_map(hist: DataFrame, by: list[str], n_frames, n_accessible, temperature: float = 300.0) -> DataFrame:
    """Direct inversion; only visited voxels are stored (see :func:`background`)."""
    return _inverted(hist, totals(hist, by, n_frames, n_accessible), by, "n", temperature, None)


def smoothed_map(hist: DataFrame, by: list[str], n_frames, n_accessible, sigma: float,
                 window: dict, temperature: float = 300.0) -> DataFrame:
    """Smooth the counts, floor them at what the kernel can resolve, then invert."""
    smooth = smoothing.gaussian_counts(hist, by, sigma, window)
    return _inverted(smooth, totals(hist, by, n_frames, n_accessible), by, "smooth", temperature,
                     thermo.detection_floor(sigma))


def background(maps: DataFrame, n_frames, n_accessible, temperature: float = 300.0,
               floor_counts: float | None = None) -> DataFrame:
    """The value every voxel not stored has, per map."""
    return maps.withColumn("background", thermo.agfe(
        F.lit(0.0), "n_atoms", n_frames, n_accessible, temperature, floor_counts))


def shown_map(energy_map: DataFrame) -> DataFrame:
    """The favourable part of a map; every other voxel reads 0 and is not stored."""
    return energy_map.filter(F.col("agfe") < 0)


def combine_types(typed: DataFrame, by: list[str]) -> DataFrame:
    """Minimum over atom types: favourable when favourable for any type."""
    return typed.groupBy(*by, *IJK).agg(F.min("agfe").alias("agfe"))


def sampling_report(per_map: DataFrame, n_frames, n_accessible, sigma: float,
                    n_kt: float = 1.0, temperature: float = 300.0) -> DataFrame:
    """Per map: what one visit is worth, the deepest well noise alone makes, and the verdict."""
    kt = thermo.kt(temperature)
    pooled = thermo.pooled_voxels(sigma)
    acc = F.lit(float(n_accessible)) if isinstance(n_accessible, (int, float)) else F.col(n_accessible)
    patches = F.greatest(F.lit(1.0), acc / F.lit(pooled))
    max_z = F.when(patches > 1, F.sqrt(F.lit(2.0) * F.ln(patches))).otherwise(F.lit(0.0))
    out = per_map.withColumn("bulk_counts_per_voxel", thermo.bulk_counts("n_atoms", n_frames, acc))
    out = out.withColumns({
        "pooled_voxels": F.lit(pooled),
        "pooled_bulk_counts": F.col("bulk_counts_per_voxel") * F.lit(pooled)})
    best = F.col("pooled_bulk_counts") + max_z * F.sqrt("pooled_bulk_counts")
    cutoff = -float(n_kt) * kt
    out = out.withColumns({
        "agfe_of_one_visit": thermo.agfe_of_counts(F.lit(1.0), "bulk_counts_per_voxel", temperature),
        "counts_at_cutoff": thermo.counts_of_agfe(F.lit(cutoff), "bulk_counts_per_voxel", temperature),
        "agfe_noise_sigma": F.lit(kt) / F.sqrt("pooled_bulk_counts"),
        "noise_floor_agfe": thermo.agfe_of_counts(best / F.lit(pooled), "bulk_counts_per_voxel",
                                                  temperature),
        "cutoff_agfe": F.lit(cutoff)})
    return out.withColumn("cutoff_below_noise_floor", F.col("cutoff_agfe") > F.col("noise_floor_agfe"))


def summary_line(report: DataFrame) -> DataFrame:
    """One readable line per map."""
    return report.withColumn("summary", F.concat(
        F.format_string("sampling: %.3f counts/voxel bulk (%.1f pooled over %.0f voxels), ",
                        "bulk_counts_per_voxel", "pooled_bulk_counts", "pooled_voxels"),
        F.format_string("1 visit = %+.2f kcal/mol, noise floor %+.2f kcal/mol vs cutoff %+.2f kcal/mol",
                        "agfe_of_one_visit", "noise_floor_agfe", "cutoff_agfe"),
        F.when(F.col("cutoff_below_noise_floor"), F.lit("  [CUTOFF BELOW NOISE FLOOR]"))
        .otherwise(F.lit("  [ok]"))))
