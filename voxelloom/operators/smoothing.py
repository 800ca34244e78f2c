"""Gaussian filters on sparse and dense voxel tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from voxelloom.lattice import IJK, in_window


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised 1-D Gaussian weights, cut at *truncate* deviations."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-reach, reach + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def _taps(weights: list[float]):
    reach = len(weights) // 2
    return F.explode(F.array(*[F.struct(F.lit(d - reach).alias("d"), F.lit(w).alias("w"))
                               for d, w in enumerate(weights)]))


def _pass(df: DataFrame, by: list[str], axis: str, weights: list[float], window: dict | None,
          reflect: bool = False) -> DataFrame:
    out = df.withColumn("_t", _taps(weights)).withColumn(axis, (F.col(axis) + F.col("_t.d")).cast("int"))
    if window is not None:
        lo, hi = window[axis]
        if reflect:
            i = F.col(axis) - F.lit(lo)
            n = hi - lo
            # Mirror with the edge sample repeated, as often as the kernel needs.
            m = F.pmod(i, F.lit(2 * n))
            out = out.withColumn(axis, (F.when(m < n, m).otherwise(F.lit(2 * n - 1) - m)
                                        + F.lit(lo)).cast("int"))
        else:
            out = out.filter((F.col(axis) >= F.lit(lo)) & (F.col(axis) < F.lit(hi)))
    return out.groupBy(*by, *IJK).agg(F.sum(F.col("smooth") * F.col("_t.w")).alias("smooth"))


def gaussian_counts(hist: DataFrame, by: list[str], sigma: float, window: dict | None = None,
                    count: str = "n") -> DataFrame:
    """Separable Gaussian of a sparse histogram with zeros around it.

    The filter runs axis by axis.  Rows are first placed by map and *i*: the passes along
    *k* and *j* keep both, so their sums need no shuffle, and only the pass along *i* does.
    A voxel the kernel does not reach is not stored; it reads the detection floor.
    """
    start = hist.select(*by, *IJK, F.col(count).cast("double").alias("smooth"))
    if window is not None:
        start = start.filter(in_window(window))
    if not sigma or sigma <= 0:
        return start
    weights = kernel(sigma)
    out = start.repartition(*by, "i")
    for axis in ("k", "j", "i"):
        out = _pass(out, by, axis, weights, window)
    return out


def gaussian_field(dense: DataFrame, by: list[str], sigma: float, window: dict,
                   value: str = "agfe") -> DataFrame:
    """Gaussian of a dense field with mirrored edges (the older, energy-space smoothing).

    A mirrored gather with a symmetric kernel is the same sum as scattering each
    voxel to the mirrored places, so the scatter passes above serve here too.
    """
    weights = kernel(sigma)
    out = dense.select(*by, *IJK, F.col(value).alias("smooth")).repartition(*by, "i")
    for axis in ("k", "j", "i"):
        out = _pass(out, by, axis, weights, window, reflect=True)
    return out


def dense_window(maps: DataFrame, window: dict) -> DataFrame:
    """Every voxel of the window for each map row; only for operators that need the dense field."""
    out = maps
    for axis in IJK:
        lo, hi = window[axis]
        out = out.withColumn(axis, F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
    return out
