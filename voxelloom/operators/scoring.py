"""Site scores: a weighted sum of features scaled over all sites."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from voxelloom.spark import cut, ranked

# Default weights, and the features whose low values are good.
DEFAULT_WEIGHTS = {
    "affinity": 3.0,
    "shape": 3.5,
    "accessible_fraction": 2.0,
    "probe_coverage": 2.0,
    "volume": 0.0,
    "kinetics": 0.0,
    "chemotype_diversity": 0.0,
    "probe_chemotype_coverage": 0.0,
    "field_contrast": 0.0,
    "field_sharpness": 0.0,
}
LOW_IS_GOOD = {"affinity", "field_contrast", "shape", "accessible_fraction"}


def resolve_weights(weights: dict | None) -> dict[str, float]:
    """Defaults with the given ones on top; an unknown name is an error."""
    bad = set(weights or {}) - set(DEFAULT_WEIGHTS)
    if bad:
        raise ValueError(f"unknown site weights {sorted(bad)}; valid: {sorted(DEFAULT_WEIGHTS)}")
    return {**DEFAULT_WEIGHTS, **(weights or {})}


def features(sites: DataFrame, fused_affinity: bool = False) -> DataFrame:
    """The ten features from whatever site columns there are; absent ones are NULL."""
    have = set(sites.columns)

    def col(*names) -> Column:
        found = [F.col(n).cast("double") for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    if fused_affinity and "fused_affinity" not in have:
        warnings.warn("fused affinity asked for but not computed; using the deepest member",
                      UserWarning, stacklevel=2)
    kinds = F.size("favorable_atomtypes").cast("double") if "favorable_atomtypes" in have else F.lit(None).cast("double")
    return sites.select(
        "site_id",
        (col("fused_affinity") if fused_affinity and "fused_affinity" in have else col("agfe_min")).alias("affinity"),
        col("solidity").alias("shape"), col("accessible_fraction").alias("accessible_fraction"),
        col("probe_coverage").alias("probe_coverage"), col("volume").alias("volume"),
        col("residence").alias("kinetics"), kinds.alias("chemotype_diversity"),
        col("probe_chemotype_coverage").alias("probe_chemotype_coverage"),
        col("fused_contrast", "field_contrast").alias("field_contrast"),
        col("fused_sharpness", "field_sharpness").alias("field_sharpness"))


def normalised(feats: DataFrame, names=tuple(DEFAULT_WEIGHTS)) -> DataFrame:
    """Each feature scaled to 0..1, higher better; flat reads 1, missing reads 0.

    The bounds are one aggregate row, joined back; no window spans all sites.
    """
    clean = feats.select("site_id", *[F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), F.col(n)).alias(n)
                                      for n in names])
    bounds = clean.agg(*[c for n in names for c in (F.min(n).alias(f"_lo_{n}"), F.max(n).alias(f"_hi_{n}"))])
    both = clean.join(F.broadcast(bounds), F.lit(True))
    out = []
    for n in names:
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        top = hi - F.col(n) if n in LOW_IS_GOOD else F.col(n) - lo
        scaled = F.when(hi - lo < 1e-20, F.lit(1.0)).otherwise(F.try_divide(top, hi - lo))
        out.append(F.when(F.col(n).isNull(), F.lit(0.0)).otherwise(scaled).alias(n))
    return both.select("site_id", *out)


def dead_weights(feats: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weighted features that cannot change the order: missing everywhere, or all the same."""
    used = [(n, w) for n, w in resolve_weights(weights).items() if w != 0.0]
    stats = feats.agg(F.count(F.lit(1)).alias("_n"), *[c for n, _ in used for c in (
        F.count(n).alias(f"_c_{n}"), F.min(n).alias(f"_lo_{n}"), F.max(n).alias(f"_hi_{n}"))])
    rows = F.array(*[F.struct(
        F.lit(n).alias("feature"), F.lit(float(w)).alias("weight"),
        F.when(F.col(f"_c_{n}") == 0, "missing")
        .when((F.col("_n") > 1) & (F.col(f"_lo_{n}") == F.col(f"_hi_{n}")), "constant").alias("why"))
        for n, w in used])
    return stats.select(F.explode(rows).alias("r")).select("r.*").filter(F.col("why").isNotNull())


def warn_dead_weights(feats: DataFrame, weights: dict | None = None) -> None:
    """Warn once per idle weight (at most one row per feature reaches the driver)."""
    for r in dead_weights(feats, weights).collect():
        warnings.warn(f"site weight {r['feature']!r}={r['weight']} has no effect: the feature is {r['why']}",
                      RuntimeWarning, stacklevel=2)


def score(feats: DataFrame, weights: dict | None = None) -> DataFrame:
    """``(site_id, combined)``."""
    total = F.lit(0.0)
    for n, w in resolve_weights(weights).items():
        if w != 0.0:
            total = total + F.lit(float(w)) * F.col(n)
    return normalised(feats).select("site_id", total.alias("combined"))


def rank(sites: DataFrame, weights: dict | None = None, fused_affinity: bool = False) -> DataFrame:
    """Sites with ``combined`` and ``rank``, the highest score first."""
    base = sites.drop("combined", "rank")
    scored = cut(score(features(base, fused_affinity), weights))
    placed = ranked(scored, [], [F.col("combined").desc(), F.col("site_id")], name="rank")
    return base.join(placed, "site_id")
