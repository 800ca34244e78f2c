"""Merge trees, distance maps and spaced peaks against plain Python."""

import numpy as np
import pytest

from voxelloom.lattice import voxel_key
from voxelloom.operators import mergetree, watershed

BY = ["probe"]


def key_saddles(f):
    """Highest pass to strictly higher ground of every peak voxel, by lowering the water level."""
    at = [tuple(v) for v in np.argwhere(f > 0)]
    near = {v: [tuple(np.add(v, o)) for o in np.ndindex(3, 3, 3) if o != (1, 1, 1)] for v in at}
    near = {v: [u for u in (tuple(np.subtract(u, 1)) for u in us) if u in near] for v, us in near.items()}
    peaks = [v for v in at if all((f[u], [-x for x in u]) < (f[v], [-x for x in v]) for u in near[v])]
    out = {}
    for p in peaks:
        best, todo = {p: f[p]}, [p]
        while todo:
            v = todo.pop()
            for u in near[v]:
                w = min(best[v], f[u])
                if w > best.get(u, 0):
                    best[u] = w
                    todo.append(u)
        out[p] = max((w for u, w in best.items() if f[u] > f[p]), default=None)
    return out


@pytest.mark.parametrize("seed,block", [(1, 32), (2, 3), (3, 2), (4, 4)])
def test_persistence_against_flooding(spark, voxels, seed, block):
    rng = np.random.default_rng(seed)
    f = np.round(rng.random((9, 8, 7)) * 4, 0 if seed % 2 else 2)       # odd seeds are full of plateaus
    f[rng.random(f.shape) < 0.35] = 0
    df = voxels(f, origin=(-3, 0, 5)).withColumnsRenamed({"agfe": "f"}).withColumn("vid", voxel_key())
    _, peaks = watershed.persistence(df, BY, block)
    got = {(r["i"] + 3, r["j"], r["k"] - 5): (r["pf"], r["key"], r["persistence"]) for r in peaks.collect()}
    want = key_saddles(f)
    assert {v: g[1] for v, g in got.items()} == want and all(g[0] == f[v] and g[2] == g[0] - (g[1] or 0) for v, g in got.items())


def test_long_chain_of_peaks_takes_few_rounds(spark, monkeypatch):
    """500 peaks in a row, each with higher ground on one side only at the end of a long way."""
    n = 500
    peaks = spark.createDataFrame([(k * 4, k * 4, 0, 0, float(10 + k)) for k in range(n)], "peak long, i int, j int, k int, pf double")
    passes = spark.createDataFrame([(k * 4, k * 4 + 4, 9.0 - k / n) for k in range(n - 1)], "a long, b long, saddle double")
    calls = []
    real = mergetree._round
    monkeypatch.setattr(mergetree, "_round", lambda *a: calls.append(a[-1]) or real(*a))
    got = {r["peak"]: r for r in mergetree.merge_tree(peaks, passes, [], 16).collect()}
    assert len(calls) <= 15 and len(got) == n
    assert all(got[k * 4]["saddle"] == 9.0 - k / n for k in range(n - 1)) and got[n * 4 - 4]["parent"] is None
    # a star: the middle is lowest and every pass leads there
    star = spark.createDataFrame([(0, 0, 0, 0, 1.0)] + [(k, k, 0, 0, float(k + 1)) for k in range(1, 120)], "peak long, i int, j int, k int, pf double")
    arms = spark.createDataFrame([(0, k, 1.0 - k / 1000) for k in range(1, 120)], "a long, b long, saddle double")
    calls.clear()
    got = {r["peak"]: r["saddle"] for r in mergetree.merge_tree(star, arms, [], 16).collect()}
    assert len(calls) <= 8 and got[0] == 1.0 - 1 / 1000 and all(got[k] == 1.0 - (k + 1) / 1000 for k in range(1, 119)) and got[119] is None


def test_equal_peaks_share_their_higher_ground(spark):
    peaks = spark.createDataFrame([(k, k, 0, 0, h) for k, h in enumerate([2.0, 2.0, 2.0, 3.0, 2.0])], "peak long, i int, j int, k int, pf double")
    passes = spark.createDataFrame([(0, 1, 1.9), (1, 2, 1.8), (2, 3, 1.0)], "a long, b long, saddle double")
    tree = mergetree.higher_ground(mergetree.merge_tree(peaks, passes, []), [])
    assert {r["peak"]: r["key"] for r in tree.collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: None, 4: None}


def squared_distances(mask):
    """Exact squared distances by the minimum over every line, axis after axis; outside is background."""
    big = np.pad(np.where(mask, np.inf, 0.0), 1)
    for axis in range(3):
        n = big.shape[axis]
        gap = (np.arange(n)[:, None] - np.arange(n)[None]) ** 2
        big = np.moveaxis(np.min(np.moveaxis(big, axis, -1)[..., None, :] + gap, axis=-1), -1, axis)
    return big[1:-1, 1:-1, 1:-1]


def test_distance_map_of_thick_and_ragged_masks(spark, voxels):
    rng = np.random.default_rng(3)
    thick = np.ones((40, 41, 42), dtype=bool)
    thick[rng.random(thick.shape) < 0.0005] = False
    ragged = rng.random((12, 13, 14)) < 0.7
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")          # runs go on over batches
    try:
        got = watershed.distance_map(voxels(ragged.astype(float)), BY)
        want = squared_distances(ragged)
        assert {(r["i"], r["j"], r["k"]): r["dist"] for r in got.collect()} == {
            tuple(v): np.sqrt(want[tuple(v)]) for v in np.argwhere(ragged)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    got = watershed.distance_map(voxels(thick.astype(float)), BY).toPandas()
    assert np.array_equal(np.sqrt(squared_distances(thick))[got["i"], got["j"], got["k"]], got["dist"]) and len(got) == thick.sum()
    assert watershed.distance_map(voxels(ragged.astype(float)).limit(0), BY).count() == 0


def test_envelope_of_long_runs():
    rng = np.random.default_rng(5)
    size = np.array([1, 2000, 3, 700])
    start = np.cumsum(size) - size
    at = np.concatenate([np.arange(n) + off for n, off in zip(size, (5, 0, -7, 100))]).astype(np.int64)
    d = rng.integers(0, 500, len(at)) ** 2 * 1.0
    got = watershed._envelope(at, start, size, d)
    for s, n in zip(start, size):
        x, y = at[s:s + n], d[s:s + n]
        assert np.array_equal(got[s:s + n], (y[None] + (x[:, None] - x[None]) ** 2).min(axis=1))


def test_spaced_peaks_are_a_maximal_independent_set(spark, monkeypatch):
    """A row of 600 equal values: few rounds, no two kept ones too close, none left out that could stay."""
    df = spark.createDataFrame([("BEN", n, 0, 0, 1.0) for n in range(600)] + [("BEN", 700, 0, 0, 5.0), ("BEN", 702, 0, 0, 4.0)],
                               "probe string, i int, j int, k int, dist double")
    writes = []
    real = watershed.cut
    monkeypatch.setattr(watershed, "cut", lambda x: writes.append(1) or real(x))
    kept = sorted(r["i"] for r in watershed.spaced_peaks(df, BY, 3).collect())
    assert len(writes) <= 1 + 2 * 8 and kept[-1] == 700 and 702 not in kept
    row = [k for k in kept if k < 600]
    assert all(b - a > 3 for a, b in zip(row, row[1:])) and all(any(abs(n - k) <= 3 for k in row) for n in range(600))
