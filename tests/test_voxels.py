import itertools
from collections import deque

import numpy as np
import pandas as pd
import pytest
from hypothesis import Phase, given, settings, strategies as st

from tests.conftest import rows
from voxelloom import lattice
from voxelloom.operators import components, density, energy, hotspots, merge, regions, smoothing, stencil, watershed
from voxelloom.functions import thermo
import voxelloom.spark
from voxelloom.spark import kth, quantile, ranked, running_total

BY = ["probe"]


def brute_components(mask, conn):
    offs = lattice.neighbour_offsets(conn)
    lab, n = np.zeros(mask.shape, int), 0
    for at in map(tuple, np.argwhere(mask)):
        if lab[at]:
            continue
        n += 1
        lab[at] = n
        todo = deque([at])
        while todo:
            v = todo.popleft()
            for o in offs:
                w = tuple(a + b for a, b in zip(v, o))
                if all(0 <= x < s for x, s in zip(w, mask.shape)) and mask[w] and not lab[w]:
                    lab[w] = n
                    todo.append(w)
    return lab


def dense(df, shape, value, fill=0):
    out = np.full(shape, fill, dtype=float)
    for r in df.collect():
        out[r["i"], r["j"], r["k"]] = r[value]
    return out


def test_keys_sort_in_raster_order():
    with pytest.raises(ValueError):
        lattice.neighbour_offsets(18)
    assert len(lattice.half_offsets(26)) == 13 and len(lattice.ball_offsets(2)) == 33
    assert lattice.key_shift(0, 0, 1) < lattice.key_shift(0, 1, 0) < lattice.key_shift(1, 0, 0)


@pytest.mark.parametrize("conn", [6, 26])
@pytest.mark.parametrize("block", [3, 32])
def test_components_match_flood_fill(spark, voxels, conn, block):
    rng = np.random.default_rng(conn + block)
    mask = rng.random((11, 9, 10)) < (0.35 if conn == 6 else 0.12)
    got = components.label(voxels(mask.astype(float), origin=(0, 0, 0)), BY, conn, block=block)
    assert (dense(got, mask.shape, "label") == brute_components(mask, conn)).all()


def test_one_long_component_over_many_blocks(voxels):
    """A snake through every block: the worst case for merging pieces."""
    mask = np.zeros((12, 12, 1))
    for i in range(12):
        mask[i, :, 0] = i % 2 == 0
        if i % 2:
            mask[i, 11 if i % 4 == 1 else 0, 0] = 1
    got = components.label(voxels(mask), BY, 6, block=2)
    assert {r["label"] for r in got.collect()} == {1}


def test_size_filter_keeps_numbers(voxels):
    mask = np.zeros((20, 20, 20))
    mask[1:6, 1:6, 1:6] = mask[13:18, 13:18, 13:18] = mask[8:10, 8:10, 8:10] = 1
    got = components.label(voxels(mask), BY, 26, 20)
    assert {(r["label"], r["n_voxels"]) for r in got.collect()} == {(1, 125), (3, 125)}


@settings(max_examples=3, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(*[st.integers(0, 4)] * 3), min_size=1, max_size=30, unique=True), st.integers(-50, 50))
def test_labels_do_not_depend_on_the_place(spark, cells, shift):
    def labels(s):
        pdf = pd.DataFrame([("A", a + s, b, c - s) for a, b, c in cells], columns=["probe", "i", "j", "k"])
        df = components.label(spark.createDataFrame(pdf, "probe string, i int, j int, k int"), BY, 6, block=4)
        return sorted((r["i"] - s, r["j"], r["k"] + s, r["label"]) for r in df.collect())
    assert labels(0) == labels(shift)


def test_morphology_against_numpy(voxels):
    rng = np.random.default_rng(1)
    mask = rng.random((8, 8, 8)) < 0.5
    window = {a: (0, 8) for a in "ijk"}
    ball = lattice.ball_offsets(1)

    def grow(m):
        out = np.zeros_like(m)
        for v in map(tuple, np.argwhere(m)):
            for o in ball:
                w = tuple(a + b for a, b in zip(v, o))
                if all(0 <= x < 8 for x in w):
                    out[w] = True
        return out

    v = voxels(mask.astype(float))
    shrunk = ~grow(~mask)
    assert (dense(stencil.dilate(v, BY, window=window).selectExpr("*", "1 AS v"), mask.shape, "v") == grow(mask)).all()
    assert (dense(stencil.dilate(v, BY, iterations=2, window=window).selectExpr("*", "1 AS v"), mask.shape, "v") == grow(grow(mask))).all()
    assert (dense(stencil.erode(v, BY, ball, window).selectExpr("*", "1 AS v"), mask.shape, "v") == shrunk).all()
    assert (dense(stencil.opening(v, BY, 1, window).selectExpr("*", "1 AS v"), mask.shape, "v") == grow(shrunk)).all()


def test_small_holes_fill_and_large_ones_stay(voxels):
    mask = np.zeros((12, 12, 12))
    mask[1:11, 1:11, 1:11] = 1
    mask[3, 3, 3:5] = 0
    mask[6:9, 6:9, 6:9] = 0
    got = components.fill_holes(voxels(mask), BY, 2, {a: (0, 12) for a in "ijk"})
    out = dense(got.selectExpr("*", "1 AS v"), mask.shape, "v")
    assert out[3, 3, 3] == out[3, 3, 4] == 1 and out[7, 7, 7] == 0 and out[0, 0, 0] == 0


def test_gaussian_against_dense_convolution(voxels):
    rng = np.random.default_rng(2)
    hist = np.where(rng.random((9, 9, 9)) < 0.1, 3.0, 0.0)
    w = np.array(smoothing.kernel(0.9333))
    assert len(w) == 9 and w.sum() == pytest.approx(1)

    def along(a, axis, mode):
        pad = [(4, 4) if n == axis else (0, 0) for n in range(3)]
        p = np.pad(a, pad, mode=mode)
        return np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), axis, p)

    window = {a: (0, 9) for a in "ijk"}
    want = along(along(along(hist, 0, "constant"), 1, "constant"), 2, "constant")
    got = smoothing.gaussian_counts(voxels(hist), BY, 0.9333, window, "agfe")
    assert np.allclose(dense(got, hist.shape, "smooth"), want)
    field = hist - 1.0
    want = along(along(along(field, 0, "symmetric"), 1, "symmetric"), 2, "symmetric")
    got = smoothing.gaussian_field(voxels(np.where(field == 0, 1e-300, field)), BY, 0.9333, window)
    assert np.allclose(dense(got, hist.shape, "smooth"), want)


def test_single_count_peaks_at_the_floor(voxels):
    h = np.zeros((25, 25, 25))
    h[12, 12, 12] = 1
    got = smoothing.gaussian_counts(voxels(h), BY, 0.9333, None, "agfe")
    peak = max(r["smooth"] for r in got.collect())
    assert peak == pytest.approx(thermo.detection_floor(0.9333), rel=0.02)


def test_five_visits_pass_the_cutoff(spark):
    """Benzene numbers: one visit reads unfavourable, some five together pass -1 kT."""
    floor = thermo.detection_floor(0.9333)
    weight = max(smoothing.kernel(0.9333)) ** 3
    df = spark.range(1, 12).selectExpr("id", f"id * {weight!r}D AS c")
    got = {r["id"]: r["e"] for r in df.select("id", thermo.agfe("c", 444.0, 1000.0, 2_921_804.0, 300.0, floor).alias("e")).collect()}
    assert got[1] > 0 and 4 <= min(n for n, e in got.items() if e < thermo.cutoff()) <= 7


def test_extent_snaps_to_the_lattice(spark):
    pos = spark.createDataFrame([("A", 1.2, 4.0, 9.9), ("A", 11.3, 5.0, 0.4)], "probe string, x double, y double, z double")
    fr = spark.createDataFrame([(10.0, 10.0, 10.0)], "lx double, ly double, lz double")
    r = density.extent(pos, fr, BY, 0.5).first()
    assert (r["lo_i"], r["n_i"]) == (0, 24) and (r["lo_k"], r["n_k"]) == (-1, 22) and (r["lo_j"], r["n_j"]) == (0, 20)
    assert density.outside_box(pos, fr, BY).first()["frac_outside"] == 0.5


def test_merge_does_not_dilute_partial_coverage(spark):
    maps = spark.createDataFrame([("A", 0, 1, 0, 0, -2.0), ("A", 1, 1, 0, 0, -4.0), ("A", 0, 5, 0, 0, -3.0)],
                                 "probe string, replica int, i int, j int, k int, agfe double")
    metas = spark.createDataFrame([("A", 0, 0, 8, 0, 1, 0, 1, 0.0), ("A", 1, 0, 4, 0, 1, 0, 1, 0.0)],
                                  "probe string, replica int, lo_i int, n_i int, lo_j int, n_j int, lo_k int, n_k int, background double")
    got = {r["i"]: (r["agfe"], r["n_cover"]) for r in merge.merge_covered(maps, metas, BY, "mean").collect()}
    assert got == {1: (-3.0, 2), 5: (-3.0, 1)}
    small = merge.merge_covered(maps, metas, BY, "mean", reference="smallest")
    assert rows(small, "i") == [(1,)]
    for bad in (lambda: merge.merge_stored(maps, BY, "mode"), lambda: merge.reference_map(metas, BY, "best")):
        with pytest.raises(ValueError):
            bad()


def test_majority_counts_only_covering_runs(spark):
    masks = spark.createDataFrame([(r, 0, 0, 0) for r in range(3)] + [(r, 1, 0, 0) for r in range(2)] + [(0, 7, 0, 0)],
                                  "replica int, i int, j int, k int")
    metas = spark.createDataFrame([(r, 0, 8 if r == 0 else 4, 0, 1, 0, 1) for r in range(5)],
                                  "replica int, lo_i int, n_i int, lo_j int, n_j int, lo_k int, n_k int")
    assert rows(merge.majority(masks, metas, []), "i") == [(0,), (7,)]


def test_alignment_relations(spark):
    base = dict(delta=0.5, n_i=10, n_j=10, n_k=10, oy=0.0, oz=0.0)
    df = spark.createDataFrame(pd.DataFrame([{"replica": n, "ox": x, **base} for n, x in enumerate((0.0, 0.023, 1.0, 0.25))]))
    got = {r["replica"]: r["relation"] for r in merge.alignment(df, []).collect()}
    assert got == {0: "aligned", 1: "aligned", 2: "shifted", 3: "resample"}
    with pytest.raises(ValueError):
        merge.check_strict(df, [], "mean")


def test_trilinear_of_a_plane_is_exact(voxels):
    i, j, k = np.meshgrid(*[np.arange(1.0, 9.0)] * 3, indexing="ij")
    got = merge.resample_trilinear(voxels(i + 2 * j - k + 20), BY, (0.5, 0.25, 0.0), {a: (0, 7) for a in "ijk"})
    out = dense(got, (7, 7, 7), "agfe")
    want = (i + 0.5 + 2 * (j + 0.25) - k + 20)[:7, :7, :7]
    assert np.allclose(out, want)


def brute_flood(g, markers):
    """Kruskal's forest with the same order of edges as the distributed one."""
    key = {tuple(v): int((v[0] << 42) + (v[1] << 21) + v[2]) for v in np.argwhere(g < 0)}
    edges = []
    for v in key:
        for o in lattice.half_offsets(6):
            w = tuple(a + b for a, b in zip(v, o))
            if w in key:
                a, b = g[v], g[w]
                edges.append(((max(a, b), min(a, b), key[v], key[w]), v, w))
    root = {v: v for v in key}
    mark = {v: markers.get(v) for v in key}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    by_mark = {}
    for v, m in markers.items():
        if m in by_mark:
            root[find(v)] = find(by_mark[m])
        by_mark.setdefault(m, v)
        mark[find(v)] = m
    for _, v, w in sorted(edges):
        a, b = find(v), find(w)
        if a == b or (mark[a] is not None and mark[b] is not None):
            continue
        root[a] = b
        mark[b] = mark[b] if mark[b] is not None else mark[a]
    return {v: mark[find(v)] for v in key}


def brute_markers(f, h):
    """Maxima whose level set {f > peak - h} holds nothing higher (26 neighbours)."""
    out = np.zeros(f.shape, bool)
    for v in map(tuple, np.argwhere(f > 0)):
        lab = brute_components(f > f[v] - h - 1e-12, 26)
        out[v] = f[lab == lab[v]].max() <= f[v]
    return out


def test_watershed_against_brute_force(voxels):
    rng = np.random.default_rng(5)
    base = rng.random((6, 5, 5)).round(2)
    f = np.where(base > 0.35, 0.6 + base * 2, 0.0)
    seeds = brute_components(brute_markers(f, 0.31), 6)
    want = brute_flood(-f, {tuple(v): int(seeds[tuple(v)]) for v in np.argwhere(seeds)})
    got = watershed.label(voxels(-f), BY, 1, h=0.31)
    have = {(r["i"], r["j"], r["k"]): r["label"] for r in got.collect()}
    assert have == {v: m for v, m in want.items() if m is not None}
    assert len(set(have.values())) == len({m for m in want.values() if m is not None}) > 1


def test_watershed_splits_and_large_h_merges(voxels):
    x, y, z = np.indices((20, 9, 9)).astype(float)
    well = lambda c: 2 * np.exp(-((x - c) ** 2 + (y - 4) ** 2 + (z - 4) ** 2) / 8)
    f = well(6) + 0.9 * well(13)
    f = np.where(f > 0.6, f, 0.0)
    two = watershed.label(voxels(-f), BY, 1, h=0.2)
    assert {r["label"] for r in two.collect()} == {1, 2} and two.count() == int((f > 0).sum())
    assert {r["label"] for r in watershed.label(voxels(-f), BY, 1, h=1.9).collect()} == {1}
    soft = watershed.label(voxels(-f), BY, 1, h=0.2, smoothing_sigma=0.5)
    assert {r["label"] for r in soft.collect()} == {1, 2}
    far = watershed.label(voxels(-f), BY, 1, watershed_mode="distance")
    assert far.count() == int((f > 0).sum())
    with pytest.raises(ValueError):
        watershed.label(voxels(-f), BY, 1, watershed_mode="height")
    with pytest.warns(RuntimeWarning):
        watershed.label(voxels(-f), BY, 1, min_distance=2)


def test_distance_map_against_brute_force(voxels):
    rng = np.random.default_rng(7)
    mask = np.pad(rng.random((6, 7, 5)) < 0.8, 1)
    empty = np.argwhere(~mask)
    got = watershed.distance_map(voxels(mask.astype(float)), BY)
    for r in got.collect():
        want = np.sqrt(((empty - (r["i"], r["j"], r["k"])) ** 2).sum(1).min())
        assert r["dist"] == pytest.approx(want)
    assert got.count() == mask.sum()


def test_strategies_by_name(voxels):
    with pytest.raises(ValueError):
        hotspots.strategy("dbscan", 0.5)
    with pytest.raises(ValueError):
        hotspots.strategy("connected_components", 0.5, depth=3)
    mask = np.zeros((6, 6, 6))
    mask[1:4, 1:4, 1:4] = -2.0
    own = lambda df, by, floor=1: components.label(df, by, 6, floor)
    assert hotspots.cluster(voxels(mask), BY, own, floor=5).count() == 27
    assert hotspots.cluster(voxels(mask), BY, hotspots.strategy("connected_components", 1.0, 20.0)).count() == 27


def test_two_depths_rank_by_depth(voxels):
    f = np.zeros((20, 20, 20))
    f[3:9, 3:9, 3:9], f[12:16, 12:16, 12:16] = -2.0, -3.0
    r = hotspots.summarise(hotspots.cluster(voxels(f), BY, components.label), BY, 0.5)
    got = {x["label"]: x for x in r.collect()}
    assert (got[2]["rank"], got[1]["rank"]) == (1, 2) and got[1]["n_voxels"] == 216
    assert got[1]["centroid_x"] == pytest.approx(3.0) and got[2]["agfe_mean_top_pct"] == -3.0


def test_shape_filter_keeps_the_missing(spark):
    df = spark.createDataFrame([(1, 0.95, 0.2), (2, None, None), (3, 0.8, 0.5), (4, float("inf"), 0.5)],
                               "label int, geom_solidity double, field_sharpness double")
    assert rows(hotspots.shape_filter(df, 0.8), "label") == [(2,), (3,), (4,)]
    assert rows(hotspots.shape_filter(df, None, 0.5), "label") == [(2,), (3,), (4,)]
    assert hotspots.shape_filter(df).count() == 4


def solid(*shape):
    out = np.zeros((12, 12, 12))
    out[1:1 + shape[0], 1:1 + shape[1], 1:1 + shape[2]] = 1
    return out


def test_solids_have_known_shapes(voxels):
    cube = solid(4, 4, 4)
    ring = solid(3, 3, 1)
    ring[2, 2, 1] = 0
    shell = solid(5, 5, 5)
    shell[2:5, 2:5, 2:5] = 0
    ell = solid(6, 6, 2)
    ell[4:7, 4:7, :] = 0
    e = lambda a: regions.euler(voxels(a), BY).first()["euler_number"]
    assert (e(cube), e(ring), e(shell)) == (1, 0, 2)
    assert regions.filled_area(voxels(shell), BY).first()["area_filled"] == 125
    assert regions.filled_area(voxels(ring), BY).first()["area_filled"] == 8
    h = regions.hulls(voxels(cube), BY).first()
    assert h["solidity"] == 1.0 and h["area_convex"] == 64
    assert h["feret_diameter_max"] == pytest.approx(np.sqrt(4.0 ** 2 + 3.0 ** 2 + 3.0 ** 2))
    lh = regions.hulls(voxels(ell), BY).first()
    assert 0.7 < lh["solidity"] < 1.0


def test_hull_counts_points_inside(voxels):
    """A ball against its supporting planes in all small integer directions."""
    x, y, z = np.indices((11, 11, 11)) - 5
    ball = x ** 2 + y ** 2 + z ** 2 <= 16
    at = np.argwhere(ball)
    rims = np.concatenate([at + s * 0.5 * e for e in np.eye(3) for s in (-1, 1)])
    ways = np.array(list(itertools.product(range(-5, 6), repeat=3)))
    grid = np.argwhere(np.ones_like(ball))
    inside = (grid @ ways.T <= (rims @ ways.T).max(0) + 1e-9).all(axis=1).sum()
    h = regions.hulls(voxels(ball.astype(float)), BY).first()
    assert h["area"] == ball.sum() and h["area_convex"] == inside


def test_axes_match_numpy(voxels):
    rng = np.random.default_rng(11)
    mask = np.zeros((12, 12, 12))
    mask[2:10, 3:7, 4:9] = rng.random((8, 4, 5)) < 0.7
    at = np.argwhere(mask).astype(float)
    c = at - at.mean(0)
    cov = c.T @ c / len(at)
    ev = np.sort(np.linalg.eigvalsh(np.trace(cov) * np.eye(3) - cov))[::-1]
    low = [p for p in regions.POWERS if sum(p) <= 2]
    r = regions.axes(regions.inertia(regions.central_moments(voxels(mask), BY, powers=low), BY), BY).first()
    assert np.allclose([r["eig_1"], r["eig_2"], r["eig_3"]], ev)
    assert r["axis_major_length"] == pytest.approx(np.sqrt(10 * (ev[0] + ev[1] - ev[2])))
    one = np.zeros((3, 3, 3))
    one[1, 1, 1] = 1
    r = regions.axes(regions.inertia(regions.central_moments(voxels(one), BY, powers=low), BY), BY).first()
    assert r["axis_major_length"] == 0.0 and r["eig_1"] == 0.0


def test_ranks_and_quantiles_of_hot_groups(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.9, "hot", "cold"), "v": rng.integers(0, 40, 3000) / 7.0})
    pdf["id"] = range(len(pdf))
    df = spark.createDataFrame(pdf).repartition(6)
    got = ranked(df, ["g"], ["v", "id"]).toPandas().sort_values(["g", "v", "id"])
    assert (got.groupby("g").cumcount() + 1 == got["rank"]).all()
    total = running_total(df, [], ["id"], "id", "b").toPandas().sort_values("id")
    assert (total["b"] == total["id"].cumsum() - total["id"]).all()
    for q in (0.001, 0.5, 0.999):
        have = {r["g"]: r["quantile"] for r in quantile(df, ["g"], "v", q).collect()}
        for g, part in pdf.groupby("g"):
            assert have[g] == pytest.approx(np.quantile(part["v"], q))


@pytest.mark.parametrize("few", [4096, 20])
def test_places_are_found_without_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(voxelloom.spark, "SELECT_ROWS", few)
    monkeypatch.setattr(voxelloom.spark, "SELECT_BINS", 64)
    rng = np.random.default_rng(9)
    parts = {"ties": rng.integers(0, 5, 400).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300),
             "ends": np.array([-np.inf, -1e308, 0.0, 2.0, 3.0, 1e308, np.inf, np.inf]), "one": np.array([7.0]), "same": np.full(50, -2.5)}
    data = [(g, float(v), int(w)) for g, p in parts.items() for v, w in zip(p, rng.integers(0, 4, len(p)) + (g == "one"))]
    df = spark.createDataFrame(data + [("ties", None, 2), ("ties", float("nan"), 2), ("none", None, 1)], "g string, v double, w bigint").repartition(5)
    places = [0, 1, 7, 60, 199, 5000]
    want = spark.createDataFrame([(g, k) for g in [*parts, "none"] for k in places], "g string, k bigint")
    for weight in (None, "w"):
        expected = {}
        for g in parts:
            line = sorted(v for name, v, w in data if name == g for _ in range(w if weight else 1))
            expected |= {(g, k): (line[k], sum(v < line[k] for v in line)) for k in places if k < len(line)}
        out = kth(df, ["g"], "v", want, weight)
        assert "rangepartitioning" not in out._jdf.queryExecution().toString()
        assert {(r["g"], r["k"]): (r["value"], r["less"]) for r in out.collect()} == expected
    alone = kth(df.where("g = 'wide'"), [], "v", spark.createDataFrame([(10,)], "k bigint")).collect()
    assert [r["value"] for r in alone] == [sorted(parts["wide"])[10]]
    assert kth(df.limit(0), ["g"], "v", want).count() == 0 and quantile(df.where("g = 'none'"), ["g"], "v", 0.5).count() == 0


def test_top_percent_with_ties(spark, monkeypatch):
    monkeypatch.setattr(voxelloom.spark, "SELECT_ROWS", 5)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"probe": "BEN", "label": rng.integers(1, 4, 500).astype("int32"), "agfe": -rng.integers(1, 9, 500) / 4.0})
    pdf["n_voxels"] = pdf.groupby("label")["agfe"].transform("size")
    got = {r["label"]: r["agfe_mean_top_pct"] for r in hotspots.top_percent(spark.createDataFrame(pdf), ["probe"], 30.0).collect()}
    want = {g: np.sort(p["agfe"])[:max(1, int(len(p) * 0.3))].mean() for g, p in pdf.groupby("label")}
    assert got == pytest.approx(want)


def test_combine_types_takes_the_lowest(spark):
    df = spark.createDataFrame([("A", "x", 0, 0, 0, -1.0), ("A", "y", 0, 0, 0, -2.0)],
                               "probe string, atype string, i int, j int, k int, agfe double")
    assert rows(energy.combine_types(df, BY), "agfe") == [(-2.0,)]


def test_offsets_cover_the_ball(spark):
    df = lattice.explode_ball(spark.range(1), 4, 12.25)
    got = {(r["di"], r["dj"], r["dk"]) for r in df.collect()}
    want = {o for o in itertools.product(range(-4, 5), repeat=3) if sum(x * x for x in o) <= 12.25}
    assert got == want
