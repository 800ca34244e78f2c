"""Region properties by name, blockwise autocorrelation and stays that close."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from voxelloom.operators import kinetics, properties, qc
from voxelloom.streaming import occupancy as stream

KEY = ["probe", "label"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    data = [("BEN", n, int(i) + 100, int(j), int(k) - 7, -float(v)) for n in (1, 2)
            for (i, j, k), v in zip(np.argwhere(rng.random((5, 6, 4)) < 0.4), rng.random(120))]
    return spark.createDataFrame(data, "probe string, label int, i int, j int, k int, agfe double")


def test_properties_by_name_from_one_grouping(spark, labelled):
    out = properties.measure(labelled, KEY)
    assert set(out.columns) == {*KEY, *(f"geom_{n}" for n in properties.REGISTRY)}
    pdf = labelled.toPandas()
    for r in out.collect():
        part = pdf[pdf["label"] == r["label"]]
        at, w = part[["i", "j", "k"]].to_numpy(), -part["agfe"].to_numpy()
        low, mid = at.min(0), at.mean(0)
        c = np.cov(at.T, bias=True)
        tensor = np.trace(c) * np.eye(3) - c
        eig = np.sort(np.linalg.eigvalsh(tensor))[::-1]
        want = {"area": len(at), "bbox": [*low, *(at.max(0) + 1)], "extent": len(at) / np.prod(at.max(0) + 1 - low), "centroid": mid,
                "centroid_local": mid - low, "centroid_weighted": (at * w[:, None]).sum(0) / w.sum(), "inertia_tensor": tensor.ravel(),
                "inertia_tensor_eigvals": eig, "axis_major_length": np.sqrt(10 * (eig[0] + eig[1] - eig[2])),
                "intensity_max": w.max(), "intensity_mean": w.mean(), "intensity_std": w.std(),
                "equivalent_diameter_area": (6 * len(at) / np.pi) ** (1 / 3)}
        for n, v in want.items():
            assert np.allclose(r[f"geom_{n}"], v, atol=1e-8), n
        assert [tuple(s) for s in r["geom_slice"]] == [(int(a), int(b), None) for a, b in zip(low, at.max(0) + 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan
    small = properties.measure(labelled, KEY, ["area"], {"deepest": F.min("agfe")})
    text = small._jdf.queryExecution().optimizedPlan().toString()
    assert small.columns == [*KEY, "geom_area", "geom_deepest"] and "covar" not in text and "stddev" not in text


def test_properties_of_users(spark, labelled):
    properties.register("half_area_test", ("n",), lambda: F.col("_n") / 2)
    try:
        got = properties.measure(labelled, KEY, ["half_area_test", "area"], {"wide": F.max("i") - F.min("i")})
        assert all(r["geom_half_area_test"] * 2 == r["geom_area"] and r["geom_wide"] == 4 for r in got.collect())
        with pytest.raises(ValueError, match="there already"):
            properties.register("area", ("n",), lambda: F.col("_n"))
    finally:
        del properties.REGISTRY["half_area_test"]
    for bad in (dict(names=["area", "perimeter"]), dict(names=["area"], extra={"area": F.count("*")})):
        with pytest.raises(ValueError):
            properties.measure(labelled, KEY, **bad)


def test_values_as_text(spark):
    df = spark.sql("""SELECT 1 AS label, 3 AS n, 0.5D AS x, double('NaN') AS bad, array(1.0D, double('Infinity')) AS l,
        array(array(1, 2), array(3)) AS nested, array(named_struct('start', 1, 'stop', 4, 'step', CAST(NULL AS INT))) AS s""")
    got = json.loads(properties.serialised(df, ["label"]).first()["properties"])
    assert got == {"n": 3, "x": 0.5, "bad": None, "l": [1.0, None], "nested": [1, 2, 3], "s": [[1, 4, None]]}


@pytest.mark.parametrize("n,every,block,max_lag", [(50, 2, 2048, None), (101, 1, 8, None), (101, 3, 7, 5), (1, 1, 4, None), (64, 1, 8, 200)])
def test_autocorrelation_in_blocks(spark, n, every, block, max_lag):
    v = np.random.default_rng(n).normal(size=n) + 3
    df = spark.createDataFrame([(int(k * 10), float(x)) for k, x in enumerate(v)], "t int, v double").repartition(3)
    x = v[::every] - v[::every].mean()
    want = np.correlate(x, x, "full")[len(x) - 1:][:None if max_lag is None else max_lag + 1]
    got = sorted(map(tuple, qc.autocorrelation(df, "t", "v", every, max_lag, block).collect()))
    assert [g[0] for g in got] == list(range(len(want))) and np.allclose([g[1] for g in got], want)
    assert n == 1 or np.allclose([g[2] for g in got], want / np.abs(want).max())
    assert qc.autocorrelation(df.limit(0), "t", "v").count() == 0


def test_closed_stays_come_once_and_leave_the_state(spark, tmp_path):
    """A long stream in small batches: every stay is appended once, late frames are dropped, the state stays small."""
    src, schema = f"{tmp_path}/in", "zone string, replica int, mol int, frame int"
    batches = [[(m, f) for m in range(3) for f in range(b * 20, b * 20 + 20) if (f // 7 + m) % 3] for b in range(5)]
    batches[3].append((0, 2))                                     # far too late
    batches.append([(9, 400)])                                    # moves the watermark past all the rest
    for rows_ in batches:
        spark.createDataFrame([("z", 0, m, f) for m, f in rows_], schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    was = spark.conf.get(stream.STATE_STORE[0], None)
    spark.conf.set(*stream.STATE_STORE)
    try:
        def put(df, n):
            df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        q = (stream.closed_stays(s, late=10).writeStream.outputMode("append").foreachBatch(put)
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        q.awaitTermination()
        seen = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset(stream.STATE_STORE[0]) if was is None else spark.conf.set(stream.STATE_STORE[0], was)
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "mol", "start", "end")
    frames = {m: sorted({f for b in batches[:5] for x, f in b if x == m and (x, f) != (0, 2)}) for m in range(3)}
    want = []
    for m, fs in frames.items():
        start = fs[0]
        for a, b in zip(fs, fs[1:] + [10 ** 6]):
            if b - a > 1:
                want.append((m, start, a))
                start = b
    assert got == sorted(want) and max(seen) <= 40 and seen
    curve = stream.running_survival(kinetics.starts_of(spark.read.parquet(f"{tmp_path}/out"), ["zone"], 3), ["zone"], 3, 99)
    whole = kinetics.survival(spark.read.parquet(f"{tmp_path}/out"), ["zone"], 3, 99)
    assert rows(curve, "tau", "sp") == rows(whole, "tau", "sp")
