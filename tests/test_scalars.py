import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions import chemotypes, export, thermo
from voxelloom.operators import energy, kinetics, scoring

KT = thermo.kt(300)


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_uniform_is_zero_and_double_is_minus_kt_ln2(spark):
    assert one(spark, thermo.agfe(F.lit(50.0), 10.0, 5.0, 1.0)) == pytest.approx(0.0, abs=1e-12)
    assert one(spark, thermo.agfe(F.lit(100.0), 10.0, 5.0, 1.0)) == pytest.approx(-KT * math.log(2))


def test_counts_and_energy_are_inverse(spark):
    for c in (0.5, 1.0, 7.0):
        back = thermo.counts_of_agfe(thermo.agfe_of_counts(F.lit(c), F.lit(0.152)), F.lit(0.152))
        assert one(spark, back) == pytest.approx(c)
    assert math.isinf(one(spark, thermo.agfe_of_counts(F.lit(0.0), F.lit(1.0))))


def test_benzene_sampling_numbers(spark):
    totals = spark.createDataFrame([("BEN", 444.0)], "probe string, n_atoms double")
    sigma = thermo.sigma_voxels()
    r = energy.summary_line(energy.sampling_report(totals, 1000, 2_921_804, sigma)).first()
    assert r["bulk_counts_per_voxel"] == pytest.approx(0.15196, rel=1e-3)
    assert r["agfe_of_one_visit"] == pytest.approx(-1.12, abs=0.01)
    assert r["pooled_voxels"] == pytest.approx(36.2, abs=0.1)
    assert r["counts_at_cutoff"] == pytest.approx(r["bulk_counts_per_voxel"] * math.e)
    assert r["summary"].startswith("sampling: 0.152 counts/voxel bulk")


def test_detection_floor_and_minimum_size():
    assert thermo.detection_floor(0.0) == 1.0
    assert thermo.detection_floor(0.9333) == pytest.approx(1 / ((2 * math.pi) ** 1.5 * 0.9333 ** 3))
    assert thermo.min_voxels(20.0, 0.8) == 39 and thermo.min_voxels(0.01, 0.5) == 1
    with pytest.raises(ValueError):
        thermo.min_voxels(20.0, 0)


def test_display_rounding_and_labels(spark):
    assert one(spark, thermo.display(F.lit(0.3))) == 0.0 and one(spark, thermo.display(F.lit(-0.3))) == -0.3
    assert one(spark, export.rounded(F.lit(float("nan")))) is None
    assert one(spark, export.rounded(F.lit(float("inf")))) is None
    text = export.property_label([("a", F.lit(-1.23456), "float"), ("b", F.lit(None).cast("double"), "float"),
                                  ("c", F.lit(1234.0), "float"), ("n", F.lit(3), "plain")])
    assert one(spark, text) == "a=-1.23 c=1.23e+03 n=3"
    for v in (0.0, 1.0, -0.5, 9.999, 99.96, 999.6, 123456.0, 0.000123456, 0.0000123, 15.625, -2.5e-7):
        assert one(spark, export.three_digits(F.lit(v))) == f"{v:.3g}"


def test_elements_fall_back_to_type_and_name(spark):
    df = spark.createDataFrame([("Cl", "x", "C1"), (None, "N3", "Q"), (None, None, "O5"), (None, None, "Q")],
                               "e string, t string, n string")
    assert [r[0] for r in df.select(export.element("e", "t", "n")).collect()] == ["CL", "N", "O", "C"]


def test_chemotype_table(spark):
    assert len(chemotypes.PROBE_CLASSES) == 28 and len(chemotypes.CLASSES) == 8
    assert all(c in chemotypes.CLASSES for v in chemotypes.PROBE_CLASSES.values() for c in v)
    with pytest.raises(ValueError, match="XYZ.*sticky"):
        chemotypes.as_table(spark, {"XYZ": ["sticky"]})
    assert len(chemotypes.problems({"A": 3, "B": ["polar", "odd"], "C": "dull", "D": "polar"})) == 3
    own = chemotypes.as_table(spark, {" ben ": "polar", "XYZ": ["anionic", "polar"], "ACT": []})
    got = sorted((r["resname"], r["chemotype"]) for r in own.filter("resname IN ('BEN', 'XYZ', 'ACT')").collect())
    assert got == [("BEN", "polar"), ("XYZ", "anionic"), ("XYZ", "polar")]
    df = spark.createDataFrame([(1, " ben "), (1, "ACT"), (2, "???")], "s int, probe string")
    got = {r["s"]: r["probe_chemotypes"] for r in chemotypes.of_groups(df, ["s"]).collect()}
    assert got == {1: ["aromatic", "hydrophobic", "hbond_acceptor", "anionic"], 2: []}
    assert one(spark, chemotypes.available(df.filter("s = 2"))) == 8
    assert one(spark, chemotypes.available(df)) == 4


SITE = "site_id int, agfe_min double, volume double, probe_coverage double, residence double, solidity double, favorable_atomtypes array<string>"


def sites(spark, *rows):
    return spark.createDataFrame(list(rows), SITE)


def combined(df, weights=None):
    return {r["site_id"]: (r["combined"], r["rank"]) for r in scoring.rank(df, weights).collect()}


def test_default_scores(spark):
    got = combined(sites(spark, (1, -3.0, 100.0, 1.0, 20.0, 0.6, ["Car", "HBA"]), (2, -1.0, 50.0, 0.5, 10.0, 0.9, ["Car"])))
    assert got[1] == (pytest.approx(8.5), 1) and got[2] == (pytest.approx(0.0), 2)


def test_negative_weight_flips_and_missing_is_zero(spark):
    off = dict.fromkeys(("affinity", "probe_coverage", "shape"), 0.0)
    two = sites(spark, (1, -3.0, 100.0, 1.0, None, 0.9, ["Car"]), (2, -1.0, 50.0, 0.5, 10.0, 0.6, ["Car"]))
    assert combined(two, {**off, "volume": -1.0})[2] == (0.0, 1)
    assert combined(two, {**off, "kinetics": 1.0}) == {1: (0.0, 2), 2: (1.0, 1)}
    with pytest.raises(ValueError):
        scoring.resolve_weights({"beauty": 1.0})


def test_idle_weights_are_named(spark):
    two = sites(spark, (1, -3.0, 100.0, 1.0, None, 0.9, ["Car"]), (2, -1.0, 50.0, 1.0, None, 0.6, ["Car"]))
    got = {r["feature"]: r["why"] for r in scoring.dead_weights(scoring.features(two), {"kinetics": 1.0}).collect()}
    assert got == {"kinetics": "missing", "probe_coverage": "constant", "accessible_fraction": "missing"}
    with pytest.warns(RuntimeWarning, match="no effect"):
        scoring.warn_dead_weights(scoring.features(two))


def test_zone_kinds_and_frame_steps():
    assert kinetics.zone_kind(7) == "resid" and kinetics.zone_kind([1.0, 2.0, 3.0]) == "point"
    assert kinetics.zone_kind([1, 2, 3]) == "resid"
    assert kinetics.frame_step([100.0, 100.0]) == (100.0, [])
    assert kinetics.frame_step([0.0])[0] == 1.0 and kinetics.frame_step([5.0], 100.0) == (100.0, [])
    assert "AKMA" in kinetics.frame_step([thermo.AKMA_PS])[1][0]
    assert "disagree" in kinetics.frame_step([1.0, 2.0])[1][0]


def test_conversions(spark):
    assert one(spark, thermo.litres_to_nm3(thermo.nm3_to_litres(F.lit(3.5)))) == pytest.approx(3.5)
    assert one(spark, thermo.copies_for(F.lit(1.0), F.lit(1e-24 * 100))) == math.floor(60.2214076 + 0.5)
    assert np.isclose(one(spark, thermo.double_decay(F.lit(0.0), F.lit(0.3), F.lit(1.0), F.lit(5.0))), 1.0)
