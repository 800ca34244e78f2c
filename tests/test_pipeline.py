import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from voxelloom.operators import builder, contacts, field, kinetics, pairs, qc, sites
from voxelloom.plans import analysis, config
from voxelloom.sources import dx, files, maps, pdb, scripts
from voxelloom.streaming import occupancy as stream


def test_survival_against_sets(spark):
    """The published recipe, spelled out with sets of molecules per frame."""
    rng = np.random.default_rng(0)
    seen = rng.random((12, 9)) < 0.6
    df = spark.createDataFrame([("z", int(m), int(f)) for f, m in np.argwhere(seen)], "zone string, mol int, frame int")
    for gap in (0, 2):
        filled = seen.copy()
        for m in range(9):
            at = np.flatnonzero(seen[:, m])
            for a, b in zip(at, at[1:]):
                if b - a <= gap + 1:
                    filled[a:b, m] = True
        want = {0: 1.0}
        for tau in range(1, 5):
            got = [filled[t:t + tau + 1].all(0).sum() / filled[t].sum() for t in range(12 - tau) if filled[t].any()]
            want[tau] = np.mean(got)
        curve = kinetics.survival(kinetics.runs(df, ["zone"], intermittency=gap), ["zone"], 4, 11, 100.0)
        have = {r["tau"]: (r["sp"], r["time_ps"]) for r in curve.collect()}
        assert {t: v[0] for t, v in have.items()} == pytest.approx(want) and have[3][1] == 300.0


def test_fits_recover_known_decays(spark):
    t = np.arange(30) * 100.0
    data = [("one", float(x), float(np.exp(-x / 700))) for x in t]
    data += [("two", float(x), float(0.7 * np.exp(-x / 150) + 0.3 * np.exp(-x / 2000))) for x in t]
    df = spark.createDataFrame(data, "zone string, time_ps double, sp double")
    got = {r["zone"]: r for r in kinetics.fits(df, ["zone"]).collect()}
    assert got["one"]["sp_tau_single"] == pytest.approx(700, rel=1e-3) and got["one"]["sp_r2_single"] == 1.0
    r = got["two"]
    assert (r["sp_amplitude_fast"], r["sp_tau_fast"], r["sp_tau_slow"]) == (
        pytest.approx(0.7, abs=0.01), pytest.approx(150, rel=0.02), pytest.approx(2000, rel=0.05))
    m = {r["zone"]: r for r in kinetics.metrics(df, ["zone"]).collect()}
    assert m["one"]["sp_half_life"] == pytest.approx(700 * np.log(2), rel=0.01)
    assert m["one"]["sp_plateau"] == pytest.approx(np.mean(np.exp(-t[-3:] / 700)), abs=1e-4)


def test_radius_and_zones(spark):
    atoms = spark.createDataFrame([("BEN", 1, 0.0, 0.0, 0.0), ("BEN", 1, 1.4, 0.0, 0.0), ("BEN", 2, 9.0, 9.0, 9.0)],
                                  "probe string, resid int, x double, y double, z double")
    assert kinetics.resolve_radius("adaptive", atoms, ["BEN"]) == {"BEN": pytest.approx(2.4)}
    assert kinetics.resolve_radius(6, atoms, ["BEN"]) == {"BEN": 6.0}
    for bad in (("wide", ["BEN"]), ("adaptive", ["XXX"])):
        with pytest.raises(ValueError):
            kinetics.resolve_radius(bad[0], atoms, bad[1])
    hs = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 0.0)], "rank int, centroid_x double, centroid_y double, centroid_z double")
    z = spark.createDataFrame([(0, 9.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0), (2, -1.0, 1.0, 0.0)], "zone_id int, x double, y double, z double")
    assert rows(kinetics.zone_to_site(z, hs, 4.0), "zone_id", "rank") == [(0, 2), (2, 1)]


def test_crowded_cell_splits_into_packs_and_keeps_all_pairs(spark):
    """All points in one cell: pair counts stay whole, packs stay small."""
    rng = np.random.default_rng(4)
    pts = rng.random((2500, 3))
    pdf = pd.DataFrame(pts, columns=list("xyz"))
    pdf["id"], pdf["f"] = np.arange(len(pdf)), 0
    df = spark.createDataFrame(pdf).repartition(2)
    packed = pairs.packs(df, ["f"], ["id"], 5.0)
    assert packed.select(F.max(F.size("id"))).first()[0] <= 1.5 * pairs.PACK
    assert packed.count() == pairs.packs(df.repartition(64), ["f"], ["id"], 5.0).count() == 10
    got = {r["bin"]: r["n"] for r in pairs.distance_counts(df, df, ["f"], "id", 1.0, 4).collect()}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(d, 9)
    assert [got[b] for b in range(4)] == list(np.histogram(d, bins=4, range=(0, 1))[0])


def test_contacts_and_superposition(spark):
    mols = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 50.0, 0.0, 0.0), (1, 1, 3.0, 0.0, 0.0)], "frame int, mol int, x double, y double, z double")
    res = spark.createDataFrame([(f, 7, 3.9, 0.0, 0.0) for f in (0, 1)] + [(1, 8, 7.5, 0.0, 0.0)], "frame int, resid int, x double, y double, z double")
    assert rows(contacts.contacts(mols, res, ["frame"]), "frame", "mol", "resid") == [(0, 1, 7), (1, 1, 7)]
    assert rows(contacts.contacts(mols, res, ["frame"], step=2), "frame") == [(0,)]
    rng = np.random.default_rng(8)
    ref = rng.random((20, 3)) * 10
    q, _ = np.linalg.qr(rng.random((3, 3)))
    q *= np.sign(np.linalg.det(q))
    turned = ref @ q.T + 5
    frame = lambda p, f: [(f, n, *map(float, v)) for n, v in enumerate(p)]
    motion = spark.createDataFrame(frame(turned, 0) + frame(turned * [1, 1, -1], 1), "frame int, atom_id int, x double, y double, z double")
    reference = spark.createDataFrame([r[1:] for r in frame(ref, 0)], "atom_id int, x double, y double, z double")
    fit = qc.superposition(motion, reference, ["frame"])
    left = {r["frame"]: r["rmsd_fit"] for r in fit.collect()}
    assert left[0] == pytest.approx(0, abs=1e-6) and left[1] > 0.5        # a mirror image does not fit
    again = {r["frame"]: r["rmsd"] for r in qc.rmsd(qc.superpose(motion, fit, ["frame"]), reference, ["frame"]).collect()}
    assert again == pytest.approx(left, abs=1e-6)


def test_field_descriptors_of_a_well(spark, voxels):
    x, y, z = np.indices((41, 41, 41))
    well = -3 * np.exp(-((x - 20) ** 2 + (y - 20) ** 2 + (z - 20) ** 2) / 18)
    window = {a: (0, 41) for a in "ijk"}
    pts = spark.createDataFrame([(1, "BEN", 10.25, 10.25, 10.25), (2, "BEN", -30.0, 0.0, 0.0), (3, "BEN", 3.0, 3.0, 3.0)],
                                "id int, probe string, x double, y double, z double")
    got = {r["id"]: r for r in field.descriptors(pts, voxels(well), ["id"], ["probe"], 0.5, window).collect()}
    assert got[1]["field_min_ball"] == -3 and got[1]["field_contrast"] < -1 and got[1]["field_sharpness"] > 0
    assert got[2]["field_min_ball"] is None and abs(got[3]["field_contrast"]) < 0.1
    dist = np.sqrt(((np.stack([x, y, z], -1) - 20) ** 2).sum(-1)) * 0.5
    assert got[1]["field_mean_ball"] == pytest.approx(well[dist <= 3].mean())
    half = voxels((x < 20).astype(float) * np.ones((41, 41, 41)))
    af = {r["id"]: r["accessible_fraction"] for r in field.accessible_fraction(pts, half, ["id"], 0.5, window, 4.0).collect()}
    assert af[1] == pytest.approx((x < 20)[dist <= 4].mean()) and af[2] is None and af[3] == 1.0


@pytest.mark.parametrize("tolerance,expected", [(0.0, 3), (2.0, 2)])
def test_sites_merge_on_touch_and_gap(spark, tolerance, expected):
    spans = {("A", 1): (5, 8), ("B", 1): (8, 11), ("A", 2): (13, 15), ("B", 2): (30, 32)}
    data = [(p, n, i, j, k) for (p, n), (a, b) in spans.items() for i in range(a, b) for j in range(3) for k in range(3)]
    df = spark.createDataFrame(data, "probe string, label int, i int, j int, k int")
    member = sites.group(df, 0.5, 6, tolerance)
    got = {(r["probe"], r["label"]): r["site_id"] for r in member.collect()}
    assert len(set(got.values())) == expected and got["A", 1] == got["B", 1] == 1
    assert sites.site_voxels(df, member).count() == len({d[2:] for d in data})      # stored undilated


def test_dx_survives_small_splits(spark, tmp_path):
    rng = np.random.default_rng(9)
    data = rng.random((7, 5, 4)) < 0.3
    vox = spark.createDataFrame([(int(i) - 3, int(j), int(k), float(i * 100 + j * 10 + k + 0.5)) for i, j, k in np.argwhere(data)],
                                "i int, j int, k int, v double")
    window = {"i": (-3, 4), "j": (0, 5), "k": (0, 4)}
    folder = f"{tmp_path}/a.dx"
    dx.write(vox, folder, window, 0.5, "v")
    single = f"{tmp_path}/one.dx"
    with open(single, "w") as out:
        for part in sorted(p for p in os.listdir(folder) if p.startswith("part-")):
            out.write(open(os.path.join(folder, part)).read())
    text = open(single).read()
    assert "counts 7 5 4" in text and "origin -1.25 0.25 0.25" in text and text.count("component") == 3
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for path in (folder, single):
            assert rows(dx.read(spark, [path]), "i", "j", "k", "value") == rows(vox, "i", "j", "k", "v")
        assert dx.read(spark, [single], keep_zero=True).count() == 140
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_text_sources(spark, tmp_path):
    p = f"{tmp_path}/zones.csv"
    open(p, "w").write("name,X,y,Z\na,1,2,3\n")
    assert rows(files.read_zones(spark, p), "x", "y", "z") == [(1.0, 2.0, 3.0)]
    open(p, "w").write("name,X,y\na,1,2\n")
    with pytest.raises(ValueError, match="missing"):
        files.read_zones(spark, p)
    open(p, "w").write("Step,Potential Energy (kJ/mole),Temperature (K),Box Volume (nm^3)\n1,-5.5,300,99\n")
    assert rows(files.read_statistics(spark, p), "energy", "temperature", "volume") == [(-5.5, 300.0, 99.0)]
    j = f"{tmp_path}/probes.json"
    open(j, "w").write('[{"resname": "BEN", "name": "benzene", "smiles": "c1ccccc1", "concentration": 0.1}]')
    assert rows(files.read_probes(spark, j), "resname", "concentration") == [("BEN", 0.1)]
    match = spark.createDataFrame([(1, 2, "Cal"), (1, 0, "HBD"), (2, 1, "Car")], "atom_id int, priority int, atype string")
    atoms = spark.createDataFrame([(1,), (2,), (3,)], "atom_id int")
    assert rows(files.assign_types(atoms, match), "atom_id", "atype") == [(1, "HBD"), (2, "Car")]
    with pytest.raises(FileNotFoundError):
        files.load_checkpoint(spark, f"{tmp_path}/none")
    names = spark.createDataFrame([("map_agfe_HBD_BEN.dx",), ("map_agfe_BEN.dx",), ("map_agfe_raw_BEN.dx",), ("map_agfe_ACT.dx",)], "file string")
    chosen = maps.choose(maps.catalog(names))
    assert rows(chosen, "probe", "atype", "kind") == [("ACT", "total", "single"), ("BEN", "HBD", "typed")]
    with pytest.raises(FileNotFoundError):
        maps.require(chosen, ["IPA"])
    lines = spark.createDataFrame([("ATOM      1  CA  ALA B   7      11.104   6.134  -6.504  1.00  2.50           C",), ("TER",)], "value string")
    r = pdb.atoms(lines).first()
    assert (r["name"], r["resname"], r["chain"], r["resid"], r["x"], r["z"], r["bfactor"], r["element"]) == (
        "CA", "ALA", "B", 7, 11.104, -6.504, 2.5, "C")


def test_config_rules(tmp_path):
    run = {"trajectory": "t.parquet", "topology": "/abs/a.parquet", "cosolvents": ["BEN"]}
    c = config.AnalysisConfig.from_dict({"out_path": "out", "simulations": [run]}, "/base")
    assert c.out_path == "/base/out" and c.simulations[0].trajectory == "/base/t.parquet"
    assert c.simulations[0].topology == "/abs/a.parquet" and c.min_voxels() == 160
    assert c.cutoff() == pytest.approx(-0.59616123)
    for bad in ({"simulations": [run]}, {"out_path": "o"}, {"out_path": "o", "simulations": [run], "extra": 1},
                {"out_path": "o", "simulations": [{"trajectory": "t"}]}, {"out_path": "o", "simulations": [{**run, "x": 1}]},
                {"out_path": "o", "simulations": [run], "hotspots": {"clustering": {"depth": 3}}},
                {"out_path": "o", "simulations": [run], "report": {"rdf": True}},
                {"out_path": "o", "simulations": [run], "density_maps": {"gridsize": "0.5"}},
                {"out_path": "o", "simulations": [run], "density_maps": {"gridsize": 0}},
                {"out_path": "o", "simulations": [run], "binding_sites": {"connectivity": 18}},
                {"out_path": "o", "simulations": [run], "binding_sites": {"probe_chemotypes": {"XYZ": ["odd"]}}},
                {"out_path": "o", "simulations": [run], "hotspots": {"survival_kwargs": {"tau": 3}}}):
        with pytest.raises(ValueError):
            config.AnalysisConfig.from_dict(bad)
    path = f"{tmp_path}/a.yaml"
    config.write_template(path)
    assert config.AnalysisConfig.from_yaml(path).binding_sites.connectivity == 6
    with pytest.raises(FileNotFoundError):
        config.AnalysisConfig.from_yaml(f"{tmp_path}/b.yaml")


def test_streams_take_late_frames_and_many_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    data = [("z", 0, 1, f) for f in (5, 6, 9, 1, 2, 7, 3)] + [("z", 0, 2, 4)]
    for n, row in enumerate(data):
        spark.createDataFrame([row], "zone string, replica int, mol int, frame int").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("zone string, replica int, mol int, frame int").option("maxFilesPerTrigger", 2).parquet(src)
    stream.run_to_table(stream.stays(s), f"{tmp_path}/out", f"{tmp_path}/state")
    got = stream.settled_stays(spark.read.parquet(f"{tmp_path}/out"))
    assert rows(got, "mol", "start", "end") == [(1, 1, 3), (1, 5, 7), (1, 9, 9), (2, 4, 4)]


def test_whole_analysis(spark, tmp_path):
    """Two runs, two probes, one shared pocket: from positions to ranked sites and files."""
    rng = np.random.default_rng(12)
    kinds = [("BEN", "C1", "C", 30, "Car"), ("ACT", "O1", "O", 30, "HBA"), ("HOH", "O", "O", 150, None), ("ALA", "CA", "C", 20, None)]
    atoms, n = [], 0
    for res, name, elem, count, kind in kinds:
        for r in range(count):
            atoms.append((n, res, name, elem, r + 1, "A", kind))
            n += 1
    topo = f"{tmp_path}/atoms.parquet"
    spark.createDataFrame(atoms, "atom_id long, resname string, name string, element string, resid long, chain string, atype string").write.parquet(topo)
    for run in range(2):
        pos = []
        for f in range(20):
            xyz = rng.random((n, 3)) * 16
            xyz[:10] = [5.0, 5.0, 5.0] + rng.random((10, 3)) * 1.5
            xyz[30:38] = [5.5, 5.5, 5.5] + rng.random((8, 3)) * 1.5
            xyz[38:44] = [12.0, 12.0, 12.0] + rng.random((6, 3)) * 1.5
            xyz[-20:] = np.array([[8.0, 2.0 + 0.3 * a, 8.0] for a in range(20)]) + rng.normal(0, 0.05, (20, 3))
            pos.append(pd.DataFrame({"frame": f, "atom_id": np.arange(n), **dict(zip("xyz", xyz.T)), "lx": 16.0, "ly": 16.0, "lz": 16.0}))
        spark.createDataFrame(pd.concat(pos)).selectExpr("cast(frame as int) frame", "atom_id", "x", "y", "z", "lx", "ly", "lz").write.parquet(f"{tmp_path}/run{run}.parquet")
    cfg = config.AnalysisConfig.from_dict({
        "out_path": f"{tmp_path}/out",
        "simulations": [{"trajectory": f"{tmp_path}/run{r}.parquet", "topology": topo, "cosolvents": ["BEN", "ACT"]} for r in range(2)],
        "density_maps": {"gridsize": 1.0},
        "hotspots": {"n_kt": 3.0, "survival_kwargs": {"sp_top_n": 2, "radius": 3.0, "max_tau": 5, "dt_ps": 100.0},
                     "clustering": {"strategy": "connected_components", "min_cluster_volume_ang3": 4.0}}})
    ranked = analysis.Analysis(spark, cfg).run().collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: r["rank"])] == list(range(1, len(ranked) + 1))
    shared = [r for r in ranked if r["cosolvents"] == ["ACT", "BEN"]]
    assert len(shared) == 1 and shared[0]["probe_coverage"] == 1.0
    assert abs(shared[0]["centroid_x"] - 6.0) < 1.0
    alone = [r for r in ranked if r["cosolvents"] == ["ACT"]]
    assert any(abs(r["centroid_x"] - 12.75) < 1.0 for r in alone)
    for name in ("rmsf_by_atom", "sampling", "maps", "merged/maps", "merged/binding_sites", "merged/session_pml",
                 "merged/survival", "hotspot_checkpoints/hotspots"):
        assert os.path.isdir(f"{tmp_path}/out/{name}"), name
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/out/merged/session_pml").collect())
    assert "pseudoatom hot_BEN, name=P1" in text and "select site_1, (hot_" in text and "load" not in text


def _analysis(spark, tmp_path, frames, cosolvents=("BEN", "ACT"), **survival):
    """Runs of different length with one always bound molecule of each probe."""
    atoms = [(n, res, name, name[0], res_id, "A", None) for n, (res, name, res_id) in enumerate(
        [("BEN", "C1", 1), ("BEN", "C2", 1), ("ACT", "O1", 2), ("ACT", "C3", 2), ("HOH", "O", 3)])]
    topo = f"{tmp_path}/atoms"
    spark.createDataFrame(atoms, "atom_id long, resname string, name string, element string, resid long, chain string, atype string").write.parquet(topo)
    place = {0: (5, 5, 5), 1: (5.5, 5, 5), 2: (5, 5, 6), 3: (5.5, 5, 6), 4: (12, 12, 12)}
    sims = []
    for run, n in enumerate(frames):
        here = ("ACT",) if run == 0 and len(cosolvents) == 1 else ("BEN", "ACT")
        rows = [(f, a, *map(float, xyz), 16.0, 16.0, 16.0) for f in range(n) for a, xyz in place.items()
                if atoms[a][1] in here or atoms[a][1] == "HOH"]
        spark.createDataFrame(rows, "frame int, atom_id long, x double, y double, z double, lx double, ly double, lz double").write.parquet(f"{tmp_path}/r{run}")
        sims.append({"trajectory": f"{tmp_path}/r{run}", "topology": topo, "cosolvents": list(here)})
    cfg = config.AnalysisConfig.from_dict({"out_path": f"{tmp_path}/o", "simulations": sims, "density_maps": {"gridsize": 1.0},
                                           "hotspots": {"survival_kwargs": {"max_tau": 8, "dt_ps": 1.0, **survival}}})
    a = analysis.Analysis(spark, cfg)
    hot = [("BEN", 1, 1, 5.0, 5.0, 5.0), ("ACT", 1, 1, 5.0, 5.0, 5.5)]
    a._made["all_hotspots"] = spark.createDataFrame(hot, "probe string, label int, rank int, centroid_x double, centroid_y double, centroid_z double")
    return a


def test_runs_of_unequal_length_keep_their_own_end(spark, tmp_path):
    a = _analysis(spark, tmp_path, (10, 30), radius=3.0)
    got = a.survival().collect()
    assert len(got) == 18 and all(r["sp_mean"] == 1.0 and r["n_replicas"] == 2 for r in got)


def test_adaptive_radius_of_a_probe_missing_from_the_first_run(spark, tmp_path):
    a = _analysis(spark, tmp_path, (5, 5), cosolvents=("ACT",), radius="adaptive")
    a.survival().collect()
    assert {r["probe"] for r in a._made["zones"].collect()} == {"BEN", "ACT"}


def test_given_zones_stay_with_their_probe(spark, tmp_path):
    zones = f"{tmp_path}/zones.csv"
    spark.createDataFrame([(5.0, 5.0, 5.0), (5.2, 5.0, 5.0), (40.0, 40.0, 40.0)], "X double, Y double, Z double").repartition(3).write.csv(zones, header=True)
    a = _analysis(spark, tmp_path, (6, 6), radius=3.0, zones_csv=zones, sp_top_n=0)
    out = a.hotspots if False else a.with_kinetics(a._made["all_hotspots"])
    got = sorted((r["probe"], r["rank"], r["sp_mrt"]) for r in out.collect())
    assert got == [("ACT", 1, 5.0), ("BEN", 1, 5.0)]
    ids = sorted(int(r["zone_id"].split("|")[1]) for r in a._made["zones"].filter("probe = 'BEN'").collect())
    assert ids == [0, 1, 2]


def test_points_of_the_settings_are_zones_and_none_means_none(spark, tmp_path):
    a = _analysis(spark, tmp_path, (6, 6), radius=3.0, sp_zones=[[5.0, 5.0, 5.0], [40, 40, 40]], sp_top_n=5)
    got = sorted((r["probe"], r["rank"], r["sp_mrt"]) for r in a.with_kinetics(a._made["all_hotspots"]).collect())
    assert got == [("ACT", 1, 5.0), ("BEN", 1, 5.0)] and a.has_kinetics()
    assert sorted(r["zone_id"] for r in a.zones().collect()) == ["ACT|0", "ACT|1", "BEN|0", "BEN|1"]
    none = {"out_path": "o", "simulations": [{"trajectory": "t", "topology": "a", "cosolvents": ["BEN"]}]}
    kept = config.AnalysisConfig.from_dict({**none, "hotspots": {"survival_kwargs": {"sp_zones": []}}})
    assert not analysis.Analysis(spark, kept).has_kinetics()
    for bad in ([[1, 2]], 3, [["a", 1, 2]]):
        with pytest.raises(ValueError, match="sp_zones"):
            config.AnalysisConfig.from_dict({**none, "hotspots": {"survival_kwargs": {"sp_zones": bad}}})


def test_stream_reads_a_folder_and_a_file(spark, tmp_path):
    df = spark.createDataFrame([("z", 0, 1, f) for f in range(40)], "zone string, replica int, mol int, frame int")
    df.repartition(5).write.parquet(f"{tmp_path}/in/folder.parquet")
    df.toPandas().to_parquet(f"{tmp_path}/in/file.parquet")
    for name in ("folder", "file"):
        s = stream.read_table(spark, f"{tmp_path}/in", name, df.schema)
        stream.run_to_table(stream.stays(s), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
        assert rows(stream.settled_stays(spark.read.parquet(f"{tmp_path}/{name}")), "start", "end") == [(0, 39)]


def test_stays_with_a_watermark_free_their_state(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "zone string, replica int, mol int, frame int"
    for n, frames in enumerate([(0, 1, 2), (500, 501), (502, 3), (900,)]):        # 3 comes too late
        spark.createDataFrame([("z", 0, 1, f) for f in frames], schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream.run_to_table(stream.stays(s, late=100), f"{tmp_path}/out", f"{tmp_path}/state")
    got = rows(stream.settled_stays(spark.read.parquet(f"{tmp_path}/out")), "start", "end")
    assert got[0] in ((0, 2), (0, 3)) and (500, 502) in got and (900, 900) in got


def test_dx_lines_of_any_width(spark, tmp_path):
    from voxelloom.sources import dx
    head = ["object 1 class gridpositions counts 2 2 3", "origin 0.5 0.5 0.5", "delta 1 0 0", "delta 0 1 0", "delta 0 0 1",
            "object 3 class array type double rank 0 items 12 data follows"]
    with open(f"{tmp_path}/a.dx", "w") as f:
        f.write("\n".join([*head, "1 2 3 4 5", "6", "7 8 9 10 11 12", 'attribute "dep" string "positions"']) + "\n")
    got = {(r["i"], r["j"], r["k"]): r["value"] for r in dx.read(spark, [f"{tmp_path}/a.dx"]).collect()}
    assert len(got) == 12 and got[0, 0, 2] == 3 and got[0, 1, 0] == 4 and got[1, 1, 2] == 12
    with open(f"{tmp_path}/b.dx", "w") as f:
        f.write("\n".join([*head, "1 2 3 4 5"]) + "\n")
    with pytest.raises(Exception, match="header says"):
        dx.read(spark, [f"{tmp_path}/b.dx"]).collect()


def test_halton_uses_all_digits(spark):
    got = builder.halton(spark.range(2).selectExpr("5 + id * (1L << 40) AS id"), "id").collect()
    assert got[0]["u"] != got[1]["u"]


def test_voxel_keys_out_of_range_are_an_error(spark):
    from voxelloom.lattice import voxel_key
    ok = spark.createDataFrame([(1, -2, 3), (1000000, -1000000, 0)], "i int, j int, k int")
    assert ok.select(voxel_key().alias("v")).distinct().count() == 2
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(1, 2, 1 << 20)], "i int, j int, k int").select(voxel_key().alias("v")).collect()
