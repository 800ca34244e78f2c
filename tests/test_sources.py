"""Maps and trajectories as data sources: many maps in one job, frames left out before they are read."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tests.conftest import rows
from voxelloom.sources import dcd, dx, dx_source

WINDOW = {"i": (-3, 4), "j": (0, 5), "k": (0, 4)}


def _maps(spark, n=3):
    rng = np.random.default_rng(1)
    data = [(f"run{m % 2}/map_{m}", int(i) - 3, int(j), int(k), float(v)) for m in range(n)
            for (i, j, k), v in zip(np.argwhere(rng.random((7, 5, 4)) < 0.3), rng.normal(size=200).round(3))]
    return spark.createDataFrame(data, dx_source.SCHEMA).repartition(4), data


def test_maps_are_written_in_one_job_and_read_back(spark, tmp_path):
    df, data = _maps(spark)
    names = spark.createDataFrame([("run0/empty", 0.0), ("run1/map_1", 2.5), ("full", -1.0)], "map string, background double")
    out = f"{tmp_path}/maps"
    far = spark.createDataFrame([("run0/map_0", 50, 0, 0, 9.0)], dx_source.SCHEMA)              # outside the window
    dx_source.write(df.unionByName(far), out, WINDOW, 0.5, maps=names)
    got = {r["map"]: {} for r in dx_source.read(spark, out, keep_zero=True).select("map").distinct().collect()}
    assert sorted(got) == ["full", "run0/empty", "run0/map_0", "run0/map_2", "run1/map_1"]
    for r in dx_source.read(spark, out, keep_zero=True).collect():
        got[r["map"]][r["i"], r["j"], r["k"]] = r["value"]
    want = {m: {} for m in got}
    for m, *at, v in data:
        want[m][tuple(at)] = v
    back = {"run1/map_1": 2.5, "full": -1.0}
    for m in got:
        assert len(got[m]) == 140 and {p: v for p, v in got[m].items() if p in want[m] or v != back.get(m, 0.0)} == want[m]
    # the same files read as lines of text by the other reader
    other = dx.read(spark, [f"{out}/run0/map_0.dx", f"{out}/run0/map_2.dx"])
    assert rows(other, "i", "j", "k", "value") == sorted(tuple(d[1:]) for d in data if d[0].startswith("run0") and d[4] != 0)
    assert not os.path.exists(f"{out}/_temporary")
    text = open(f"{out}/run0/empty.dx").read()
    assert "counts 7 5 4" in text and "origin -1.25 0.25 0.25" in text
    # a second write replaces the first
    dx_source.write(df.filter("map = 'run0/map_0'"), out, WINDOW, 0.5)
    assert [r["map"] for r in dx_source.read(spark, out).select("map").distinct().collect()] == ["run0/map_0"]


def test_map_filters_open_only_their_files(spark, tmp_path):
    df, _ = _maps(spark)
    out = f"{tmp_path}/maps"
    dx_source.write(df, out, WINDOW, 0.5)
    reader = dx_source.DxReader({"path": out})
    list(reader.pushFilters([EqualTo(("map",), "run0/map_2")]))
    assert [p.name for p in reader.partitions()] == ["run0/map_2"]
    os.rename(f"{out}/run1/map_1.dx", f"{out}/run1/kept.txt")
    open(f"{out}/run1/map_1.dx", "w").write("broken")
    assert dx_source.read(spark, out).filter(F.col("map").startswith("run0/")).count() > 0
    assert dx_source.read(spark, out).filter(F.col("map").isin("run0/map_0", "run0/none")).select("map").distinct().count() == 1
    with pytest.raises(Exception, match="no header"):
        dx_source.read(spark, out).count()


def test_map_writer_wants_order_and_whole_headers(spark, tmp_path):
    df, _ = _maps(spark)
    twice = df.unionByName(df.limit(1))
    with pytest.raises(Exception, match="raster order"):
        dx_source.write(twice, f"{tmp_path}/twice", WINDOW, 0.5)
    assert not os.path.exists(f"{tmp_path}/twice/_temporary")
    dx_source.write(df.filter("map = 'run0/map_0'"), f"{tmp_path}/one", WINDOW, 0.5)
    text = open(f"{tmp_path}/one/run0/map_0.dx").read()
    open(f"{tmp_path}/short.dx", "w").write(text.replace("counts 7 5 4", "counts 7 5 5"))
    with pytest.raises(Exception, match="header says"):
        dx_source.read(spark, f"{tmp_path}/short.dx").count()


def test_large_map_streams_through_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dx_source, "_CHUNK", 64)
    writer = dx_source.DxWriter({"path": f"{tmp_path}/m", "gridsize": "1", "window": '{"i":[0,12],"j":[0,12],"k":[0,12]}'},
                                ["map", "i", "j", "k", "value"], True)
    import pyarrow as pa
    at = [(0, 0, 3), (5, 5, 5), (11, 11, 11)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["a"]), *(pa.array([x], pa.int32()) for x in p), pa.array([1.5 + n])],
                                          schema=dx_source._FIELDS) for n, p in enumerate(at)]
    writer.commit([writer.write(iter(batches))])
    reader = dx_source.DxReader({"path": f"{tmp_path}/m"})
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == [("a", *p, 1.5 + n) for n, p in enumerate(at)]


@pytest.fixture
def movie(spark, tmp_path):
    rng = np.random.default_rng(2)
    n, frames = 40, 100
    xyz = rng.random((frames, n, 3)).astype("float32").astype(float) * 8
    pdf = pd.DataFrame({"frame": np.repeat(np.arange(frames), n), "atom_id": np.tile(np.arange(n), frames),
                        **{c: xyz[:, :, k].ravel() for k, c in enumerate("xyz")}, "lx": 16.0, "ly": 17.0, "lz": 18.0})
    df = spark.createDataFrame(pdf).selectExpr("cast(frame as int) frame", "atom_id", "x", "y", "z", "lx", "ly", "lz")
    path = f"{tmp_path}/movie"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")          # several files
    dcd.write(df, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, pdf


def test_trajectory_round_trip(spark, movie):
    path, pdf = movie
    got = dcd.read(spark, path).toPandas().sort_values(["frame", "atom_id"])
    assert len(os.listdir(path)) > 1 and np.array_equal(got["frame"], pdf["frame"]) and np.array_equal(got["atom_id"], pdf["atom_id"])
    for c in ("x", "y", "z", "lx", "ly", "lz"):
        assert np.array_equal(got[c].astype("float32"), pdf[c].astype("float32"))


def test_frames_and_atoms_are_left_out_before_reading(spark, movie):
    path, pdf = movie
    got = dcd.read(spark, path, step=5).filter("frame >= 20 AND frame < 61 AND atom_id IN (1, 7, 99)")
    want = pdf[(pdf["frame"] % 5 == 0) & pdf["frame"].between(20, 60) & pdf["atom_id"].isin([1, 7])]
    assert rows(got, "frame", "atom_id") == sorted(zip(want["frame"], want["atom_id"]))

    def asked(step, *filters):
        reader = dcd.DcdReader({"path": path, "step": str(step), "framespertask": "8"})
        assert len(list(reader.pushFilters(list(filters)))) == len(filters)
        parts = reader.partitions()
        assert all(p.count <= 8 for p in parts)
        return sorted(p.base + p.first + k * p.step for p in parts for k in range(p.count))
    assert asked(1) == list(range(100))
    assert asked(5, GreaterThanOrEqual(("frame",), 20), LessThan(("frame",), 61)) == list(range(20, 61, 5))
    assert asked(1, In(("frame",), (3, 98, 500))) == [3, 98] and asked(2, EqualTo(("frame",), 3)) == []
    assert dcd.read(spark, path).filter("frame = 98").count() == 40 and dcd.read(spark, path).filter("frame > 500").count() == 0


def test_broken_trajectories_are_errors(spark, tmp_path, movie):
    path, _ = movie
    first = sorted(os.listdir(path))[0]
    raw = open(f"{path}/{first}", "rb").read()
    open(f"{tmp_path}/short.dcd", "wb").write(raw[:-10])
    with pytest.raises(Exception, match="last whole frame"):
        dcd.read(spark, f"{tmp_path}/short.dcd").count()
    open(f"{tmp_path}/other.dcd", "wb").write(b"\\x54\\0\\0\\0" + b"VELD" + raw[8:])
    with pytest.raises(Exception, match="coordinate|record"):
        dcd.read(spark, f"{tmp_path}/other.dcd").count()
    gap = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0), (2, 0, 1.0, 1.0, 1.0)], "frame int, atom_id long, x double, y double, z double")
    with pytest.raises(Exception, match="follow each other"):
        gap.select("frame", "atom_id", "x", "y", "z", *[F.lit(None).cast("double").alias(c) for c in ("lx", "ly", "lz")]).coalesce(
            1).write.format("dcd").mode("overwrite").save(f"{tmp_path}/gap")


def test_pdb_numbers_wider_than_their_fields(spark):
    """Atoms from 100,000 and residues from 10,000 on stay in their columns, and all numbers come back."""
    from voxelloom.sources import pdb
    ids = [(1, 1), (-999, -99), (99_999, 9_999), (100_000, 10_000), (43_770_015, 1_223_055), (43_770_016, 1_223_056),
           (87_440_031, 2_436_111), (87_440_032, 7), (5, 2_436_112), (9_000_000_000, -123_456), (-10_000, 3)]
    df = spark.createDataFrame([(a, r, "CA", "ALA", "B", 1.5, -2.25, 30.125) for a, r in ids],
                               "atom_id bigint, resid bigint, name string, resname string, chain string, x double, y double, z double")
    lines = [r["value"] for r in pdb.to_lines(df).collect()]
    assert [(v[6:11], v[22:26]) for v in lines[3:7]] == [("A0000", "A000"), ("ZZZZZ", "ZZZZ"), ("a0000", "a000"), ("zzzzz", "zzzz")]
    assert all(v[17:20] == "ALA" and v[76:78] == " C" for v in lines)
    back = pdb.atoms(pdb.to_lines(df).select("value"))
    assert rows(back, "atom_id", "resid") == sorted(ids)
    assert rows(back, "chain", "x", "y", "z", "element") == [("B", 1.5, -2.25, 30.125, "C")] * len(ids)
