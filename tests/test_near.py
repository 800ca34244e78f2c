"""Near pairs, contacts and zones by cells against brute force, and that dense clouds cost no pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from voxelloom.operators import builder, kinetics, pairs, qc


def _points(n, seed, box=20.0, crowd=0.0):
    rng = np.random.default_rng(seed)
    xyz = rng.random((n, 3)) * box
    some = rng.random(n) < crowd
    xyz[some] = 7 + rng.random((some.sum(), 3))
    return xyz


@pytest.mark.parametrize("crowd", [0.0, 0.6])
def test_pair_counts_of_points_with_themselves_in_a_periodic_box(spark, monkeypatch, crowd):
    xyz = _points(900, 3, crowd=crowd).round(2)
    df = spark.createDataFrame([(n % 2, n, *map(float, p)) for n, p in enumerate(xyz)], "f int, id int, x double, y double, z double")
    made = []
    real = pairs.packs
    monkeypatch.setattr(pairs, "packs", lambda *a: made.append(a) or real(*a))
    got = pairs.distance_counts(df, df, ["f"], "id", 6.0, 12, (20.0,) * 3)
    assert len(made) == 1                                                   # one side only, each pair of packs once
    want = np.zeros(12, int)
    for f in (0, 1):
        gap = xyz[f::2][:, None] - xyz[f::2][None]
        gap -= 20 * np.rint(gap / 20)
        d = np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2)
        np.fill_diagonal(d, 99)
        want += np.histogram(d[d <= 6], bins=12, range=(0, 6))[0]
    n = {r["bin"]: r["n"] for r in got.collect()}
    assert [n[b] for b in range(12)] == list(want)
    other = df.select("*")
    assert rows(pairs.distance_counts(df, other, ["f"], "id", 6.0, 12, (20.0,) * 3), "bin", "n") == rows(got, "bin", "n")


def test_points_without_a_name_are_counted_only_between_two_kinds(spark):
    df = spark.createDataFrame([(0, n, float(n), 0.0, 0.0) for n in (1, 2)] + [(0, None, 3.0, 0.0, 0.0)], "f int, id bigint, x double, y double, z double")
    ids = df.withColumn("id", F.col("id") + 10)
    assert sum(r["n"] for r in qc.rdf(df, df, ["f"], "id", 2.0, 4, box=20.0).collect()) == 2
    assert sum(r["n"] for r in qc.rdf(df, ids, ["f"], "id", 2.0, 4, box=20.0, same=False).collect()) == 9


def test_packs_that_are_far_apart_do_not_meet(spark):
    xyz = _points(6000, 5, box=2.0)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(xyz)), **{c: xyz[:, n] for n, c in enumerate("xyz")}}))
    packed = pairs.packs(df, [], ["id"], 2.0)
    met = pairs.neighbours(packed, pairs.packs(df, [], ["id"], 2.0), [], 0.5)
    assert met.count() < 0.7 * packed.count() ** 2


def test_counts_of_near_pairs_by_group(spark):
    a, b = _points(1500, 7, crowd=0.5).round(1), _points(800, 8, crowd=0.5).round(1)
    schema = "g int, x double, y double, z double"
    left = spark.createDataFrame([(n % 7, *map(float, p)) for n, p in enumerate(a)] + [(1, None, 0.0, 0.0)], schema)
    right = spark.createDataFrame([(n % 5, *map(float, p)) for n, p in enumerate(b)] + [(2, float("nan"), 0.0, 0.0)], schema)
    got = builder.near_pairs(left.withColumnRenamed("g", "l"), right.withColumnRenamed("g", "r"), "l", "r", 2.0)
    sq = ((a[:, None] - b[None]) ** 2)
    sq = sq[..., 0] + sq[..., 1] + sq[..., 2]
    want = []
    for i in range(7):
        for j in range(5):
            part = sq[i::7, j::5]
            want.append((i, j, int((part <= 4).sum()), float(np.sqrt(part.min()))))
    assert rows(got, "l", "r", "n_pairs", "least") == [w for w in want if w[2]]


def test_contacts_found_by_cells_are_not_looked_for_in_pairs(spark, monkeypatch):
    schema = "f int, name string, x double, y double, z double"
    looked = []
    real = pairs.packs
    monkeypatch.setattr(pairs, "packs", lambda df, *a: looked.append(df.count()) or real(df, *a))
    # two clouds in one place: every pair of names shares a cell
    a, b = _points(2000, 1, box=1.0), _points(2000, 2, box=1.0)
    cloud = lambda xyz, k: spark.createDataFrame([(0, f"{n % k}", *map(float, p)) for n, p in enumerate(xyz)], schema)
    found = pairs.touching(cloud(a, 9).withColumnRenamed("name", "m"), cloud(b, 6).withColumnRenamed("name", "r"), ["f"], "m", "r", 2.0)
    assert found.count() == 54 and looked == [0, 0]
    # sparse, with names that are missing: as by brute force
    a, b = _points(400, 3), _points(300, 4)
    names = lambda n, k: None if n % k == 0 else f"{n % k}"
    make = lambda xyz, k: spark.createDataFrame([(n % 2, names(n, k), *map(float, p)) for n, p in enumerate(xyz)], schema)
    got = pairs.touching(make(a, 40).withColumnRenamed("name", "m"), make(b, 30).withColumnRenamed("name", "r"), ["f"], "m", "r", 2.0)
    sq = ((a[:, None] - b[None]) ** 2).sum(-1)
    want = {(n % 2, names(n, 40), names(m, 30)) for n, m in zip(*np.nonzero(sq <= 4)) if n % 2 == m % 2}
    assert len(want) > 100 and {(r["f"], r["m"], r["r"]) for r in got.collect()} == want


@pytest.mark.parametrize("again", [False, True])
def test_zones_without_a_row_for_each_atom_inside(spark, monkeypatch, again):
    """As by the rows of ``occupancy``; equal zones count twice, and a name with two spheres takes the way by rows."""
    xyz = _points(3000, 6, crowd=0.3).round(1)
    atoms = spark.createDataFrame([(f"p{n % 2}" if n % 50 else None, n % 3, None if n % 41 == 0 else n % 23, None if n % 53 == 0 else n % 11, *map(float, p))
                                   for n, p in enumerate(xyz)], "probe string, replica int, mol int, frame int, x double, y double, z double")
    at = [(n, *map(float, p), 2.0 + n % 3) for n, p in enumerate(_points(40, 9).round(1))]
    at += [at[0], (3 if again else 40, 7.5, 7.5, 7.5, 0.5)]
    zones = spark.createDataFrame(at, "zone_id int, x double, y double, z double, radius double")
    inside = kinetics.occupancy(atoms, zones)
    want = inside.groupBy("zone_id", "probe").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("frame").alias("n_frames"),
                                                  F.count_distinct("mol").alias("n_mols")).collect()
    by = ["probe", "replica"]
    curve = {}
    for gap in (0, 2):
        stays = kinetics.runs(inside.where("frame IS NOT NULL"), ["zone_id", *by], intermittency=gap)
        curve[gap] = kinetics.survival(stays, ["zone_id", *by], 3, 10).collect()
    if not again:
        monkeypatch.setattr(kinetics, "occupancy", lambda *a, **k: pytest.fail("a row for each atom inside"))
    for dense in (1 << 24, 1):
        for held in (1 << 21, 100):
            monkeypatch.setattr(kinetics, "DENSE_VISITS", dense)
            monkeypatch.setattr(kinetics, "HELD_VISITS", held)
            monkeypatch.setattr(kinetics, "BUCKET_POINTS", 1 << 22 if dense > 1 else 1000)
            got = kinetics.zone_counts(atoms, zones, ["probe"])
            assert sorted(map(repr, got.select("zone_id", "probe", "n_rows", "n_frames", "n_mols").collect())) == sorted(map(repr, want))
            for gap in (0, 2):
                new = kinetics.zone_survival(atoms.where("frame IS NOT NULL"), zones, by, 3, 10, intermittency=gap)
                key = lambda r: (r["zone_id"], r["probe"], r["replica"], r["tau"])
                a, b = {key(r): r["sp"] for r in new.collect()}, {key(r): r["sp"] for r in curve[gap]}
                assert len(a) == len(b) > 500 and a == pytest.approx(b, abs=1e-12)
            if again:
                return


def _lattice(spark, n, box, step, seed, names):
    """Points on a lattice, so that many distances lie on the edges of bins."""
    xyz = np.random.default_rng(seed).integers(0, int(box / step), (n, 3)) * step
    return xyz, spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % names, "id": np.arange(n), **{c: xyz[:, k] for k, c in enumerate("xyz")}}))


def test_copies_of_packs_are_not_broadcast(spark):
    """A small file of packs says nothing about its copies in the cells around: they stay out of the driver."""
    _, df = _lattice(spark, 900, 12.0, 0.25, 11, 5)
    packed, other = (pairs.packs(df, [], ["id"], 2.0) for _ in range(2))
    for right in (packed, other):
        met = pairs.neighbours(packed, right, [], 2.0)
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    half, whole = (pairs.neighbours(packed, right, [], 2.0).count() for right in (packed, other))
    assert 2 * half == whole + packed.count()               # each pair of packs once


@pytest.mark.parametrize("box", [None, 12.0])
def test_distances_on_the_edges_of_bins_and_names_that_come_twice(spark, box):
    xyz, df = _lattice(spark, 3000, 12.0, 0.25, 12, 5)
    df = df.withColumn("id", F.col("id") % 2800)
    got = {r["bin"]: r["n"] for r in pairs.distance_counts(df, df, [], "id", 4.0, 16, (box,) * 3 if box else None).collect()}
    want = np.zeros(16, np.int64)
    ids = np.arange(3000) % 2800
    for k in range(0, 3000, 500):
        gap = xyz[k:k + 500, None] - xyz[None]
        if box:
            gap -= box * np.rint(gap / box)
        d = np.sqrt((gap ** 2).sum(-1))
        d[ids[k:k + 500, None] == ids[None]] = 99
        want += np.histogram(d[d <= 4], bins=16, range=(0, 4))[0]
    assert [got[b] for b in range(16)] == list(want)


def test_float32_squares_are_as_near_as_they_say():
    x, y = (np.random.default_rng(n).random((3, 300)) * 6 + 1000 + 7 * n for n in (1, 2))
    sq, err, top = pairs.squares(x, y, np.empty(300 * 300, np.float32), 0.5)
    want = ((x[:, :, None] - y[:, None]) ** 2).sum(0) / 0.25
    assert np.abs(sq - want).max() < err < 1e-2 and want.max() <= top * top


def test_near_pairs_leave_a_task_once_by_name(spark):
    """Not a row for each pair of packs and names: sums over all that a task meets, in parts if there are many names."""
    a, left = _lattice(spark, 3000, 6.0, 0.25, 13, 7)
    b, right = _lattice(spark, 2500, 6.0, 0.25, 14, 5)
    both = pairs.neighbours(pairs.packs(left, [], ["g"], 2.0), pairs.packs(right, [], ["g"], 2.0), [], 2.0)
    table = both.withColumn("same", F.struct("l_pack.*")).toArrow().combine_chunks()
    assert table.num_rows > 35
    sq = ((a[:, None] - b[None]) ** 2).sum(-1)
    want = {(i, j): (int((sq[i::7, j::5] <= 4).sum()), float(sq[i::7, j::5].min())) for i in range(7) for j in range(5)}
    for places in (1 << 20, 1):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(pairs, "_TABLE", places)
            parts = [r for out in pairs.totals(table.to_batches(), "g", "g", 2.0) for r in zip(*(np.asarray(v).tolist() for v in out))]
        assert len(parts) == 35 or places == 1
        got = {}
        for i, j, n, s in parts:
            n0, s0 = got.get((i, j), (0, np.inf))
            got[i, j] = n0 + n, min(s0, s)
        assert got == want


def test_sums_of_a_zone_are_ended_where_its_visits_are(spark, monkeypatch):
    """Many points, but tables of visits that stay small: one bucket, and no rows by start frame, frame or molecule to add up."""
    xyz = _points(3000, 16, crowd=0.3).round(1)
    atoms = spark.createDataFrame([("p", n % 3, None if n % 41 == 0 else n % 23, n % 11, *map(float, p)) for n, p in enumerate(xyz)],
                                  "probe string, replica int, mol int, frame int, x double, y double, z double")
    zones = spark.createDataFrame([(n, *map(float, p), 2.0 + n % 3) for n, p in enumerate(_points(40, 9).round(1))],
                                  "zone_id int, x double, y double, z double, radius double")
    inside, by = kinetics.occupancy(atoms, zones), ["probe", "replica"]
    curve = rows(kinetics.survival(kinetics.runs(inside, ["zone_id", *by]), ["zone_id", *by], 3, 10, 2.0), "zone_id", "replica", "tau", "time_ps", "sp")
    want = inside.groupBy("zone_id", "replica").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("frame").alias("n_frames"),
                                                    F.count_distinct("mol").alias("n_mols"))
    cols = "zone_id", "replica", "n_rows", "n_frames", "n_mols"
    want = rows(want, *cols)
    monkeypatch.setattr(kinetics, "BUCKET_POINTS", 100)
    monkeypatch.setattr(kinetics, "ENOUGH_PACKS", 1)
    monkeypatch.setattr(kinetics, "survival_of", lambda *a, **k: pytest.fail("a row for each start frame"))
    got = rows(kinetics.zone_survival(atoms, zones, by, 3, 10, 2.0), "zone_id", "replica", "tau", "time_ps", "sp")
    assert len(got) > 300 and [r[:4] for r in got] == [r[:4] for r in curve]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in curve], abs=1e-12)
    got = kinetics.zone_counts(atoms, zones, ["replica"])
    assert rows(got, *cols) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0
