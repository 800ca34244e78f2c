"""The fused passes against the operators that each read the positions on their own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from voxelloom.lattice import IJK
from voxelloom.operators import density, kinetics, qc, scan

COLS = "sim string, sim_no int, frame int, atom_id long, name string, resname string, resid long, role string, atype string, x double, y double, z double"


@pytest.fixture(scope="module")
def positions(spark):
    rng = np.random.default_rng(11)
    kinds = [("C1", "BEN", "probe", "Car"), ("H1", "BEN", "probe", None), ("O1", "ACT", "probe", "HBA"), ("O", "HOH", "water", None),
             ("H", "HOH", "water", None), ("CA", "ALA", "protein", None), ("CB", "ALA", "protein", None), ("HB", "ALA", "protein", None)]
    data = []
    for sim in range(2):
        for f in range(12):
            for n in range(48):
                name, res, role, kind = kinds[n % 8]
                if sim == 0 and res == "ACT":
                    continue
                data.append((f"s{sim}", sim, f, n, name, res, n // 8, role, kind, *(float(v) for v in rng.random(3) * 9)))
    return spark.createDataFrame(data, COLS).repartition(5)


def test_one_pass_equals_the_single_operators(spark, positions):
    got = scan.by_kind(scan.accumulate(positions, 1.5, 5)).persist()
    probes = positions.filter("role = 'probe'").withColumn("probe", F.col("resname"))
    heavy = lambda df: df.filter("NOT name LIKE 'H%'")

    def same(a, b, *cols):
        def text(df):
            return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.select(*cols).collect())
        assert text(a) == text(b) and text(a)

    box = positions.groupBy("sim", "frame").agg(*[(F.max(c) - F.min(c)).alias(f"l{c}") for c in "xyz"], *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    same(scan.frames(got), box, "sim", "frame", "lx", "ly", "lz", "cx", "cy", "cz")
    same(density.extent_of(scan.spans(got), scan.frames(got), ["sim", "probe"], 1.5, ["sim"]),
         density.extent(probes, box, ["sim", "probe"], 1.5, ["sim"]), "sim", "probe", "lo_i", "n_i", "lo_j", "n_j", "lo_k", "n_k")
    same(scan.counts(got), density.histogram(probes, ["sim", "probe", "atype"], 1.5), "sim", "probe", "atype", *IJK, "n")
    strided = density.stride(positions, 5)
    voxels = lambda df, *by: density.with_voxel(df, 1.5).select(*by, *IJK).distinct()
    same(scan.seen(got, "water"), voxels(strided.filter("role = 'water' AND name = 'O'"), "sim"), "sim", *IJK)
    same(scan.seen(got, "probe"), voxels(heavy(strided.filter("role = 'probe'").withColumn("probe", F.col("resname"))), "sim", "probe"),
         "sim", "probe", *IJK)
    same(scan.seen(got, "protein"), voxels(heavy(strided.filter("role = 'protein'")), "sim"), "sim", *IJK)
    same(scan.fluctuation(got), qc.rmsf(heavy(positions.filter("role = 'protein'")), ["sim", "atom_id", "resid"]), "sim", "atom_id", "resid", "rmsf")
    order = spark.createDataFrame([("s0", 0), ("s1", 1)], "sim string, sim_no int")
    first = heavy(probes).filter("frame = 0 AND ((probe = 'BEN' AND sim_no = 0) OR (probe = 'ACT' AND sim_no = 1))")
    same(scan.first_places(got, order), first, "probe", "resid", "x", "y", "z")

    zones = spark.createDataFrame([("BEN", "a", 4.0, 4.0, 4.0, 3.0), ("BEN", "b", 5.0, 5.0, 5.0, 2.0), ("ACT", "c", 2.0, 7.0, 3.0, 3.5)],
                                  "probe string, zone_id string, x double, y double, z double, radius double")
    reference = scan.mean_places(got, "CA")
    ca = positions.filter("role = 'protein' AND name = 'CA'").withColumn("key", F.concat_ws("|", "sim", "atom_id"))
    want_fit = qc.superposition(ca, qc.average_structure(ca, "key"), ["sim", "frame"], "key")
    want_in = kinetics.occupancy(probes.select("sim", "probe", "frame", "atom_id", "x", "y", "z"), zones, keys=("probe",))
    for z, r in ((zones, reference), (zones, None), (None, reference)):
        second = scan.by_kind(scan.follow(positions, z, r))
        if z is not None:
            same(scan.kind(second, "zone"), want_in, "sim", "probe", "frame", "atom_id", "zone_id")
        if r is not None:
            same(qc.decompose(scan.kind(second, "fit"), ["sim", "frame"]), want_fit, "sim", "frame", "rmsd_fit")
    got.unpersist()


def test_box_edges_of_the_rows_win(spark, positions):
    edged = positions.withColumns({f"l{c}": F.lit(10.0 + n) for n, c in enumerate("xyz")})
    got = scan.frames(scan.accumulate(edged, 1.5, 5))
    assert {(r["lx"], r["ly"], r["lz"]) for r in got.collect()} == {(10.0, 11.0, 12.0)}


def test_a_whole_run_reads_the_trajectories_twice(spark, tmp_path):
    from voxelloom.plans import analysis, config
    rng = np.random.default_rng(3)
    atoms = [(n, "BEN" if n < 20 else "HOH" if n < 60 else "ALA", "C1" if n < 20 else "O" if n < 60 else "CA", "C", n, "A") for n in range(70)]
    topo = f"{tmp_path}/atoms.parquet"
    spark.createDataFrame(atoms, "atom_id long, resname string, name string, element string, resid long, chain string").write.parquet(topo)
    for run in range(2):
        pos = []
        for f in range(15):
            xyz = rng.random((70, 3)) * 12
            xyz[:8] = [4.0, 4.0, 4.0] + rng.random((8, 3))
            xyz[60:] = np.array([[8.0, 1.0 + 0.7 * a, 8.0 + a % 3] for a in range(10)]) + rng.normal(0, 0.05, (10, 3))
            pos.append(pd.DataFrame({"frame": f, "atom_id": np.arange(70), **dict(zip("xyz", xyz.T))}))
        spark.createDataFrame(pd.concat(pos)).selectExpr("cast(frame as int) frame", "atom_id", "x", "y", "z").write.parquet(
            f"{tmp_path}/walk{run}.parquet")
    cfg = config.AnalysisConfig.from_dict({
        "out_path": f"{tmp_path}/out",
        "simulations": [{"trajectory": f"{tmp_path}/walk{r}.parquet", "topology": topo, "cosolvents": ["BEN"]} for r in range(2)],
        "density_maps": {"gridsize": 1.0},
        "hotspots": {"n_kt": 3.0, "survival_kwargs": {"sp_top_n": 2, "radius": "adaptive", "max_tau": 4, "dt_ps": 10.0},
                     "clustering": {"strategy": "connected_components", "min_cluster_volume_ang3": 1.0}}})
    seen = spark._jsparkSession.sharedState().statusStore()
    before = seen.executionsCount()
    assert analysis.Analysis(spark, cfg).run().count() >= 1
    plans = [seen.executionsList(int(before), int(seen.executionsCount() - before)).apply(n).physicalPlanDescription()
             for n in range(int(seen.executionsCount() - before))]
    reading = [p for p in plans if "walk0.parquet" in p]
    assert len(plans) > 10 and len(reading) == 2 and not any("walk1.parquet" in p for p in plans if p not in reading)
    files = sorted(p.relative_to(tmp_path / "out/dx").as_posix() for p in (tmp_path / "out/dx").rglob("*.dx"))
    assert files == ["merged/accessible_mask.dx", "merged/binding_site_labels.dx", "merged/hotspot_labels_BEN.dx", "merged/map_agfe_BEN.dx",
                     *[f"sim_{r}/map_agfe_{kind}BEN.dx" for r in range(2) for kind in ("", "raw_")]]
    from voxelloom.sources import dx_source
    shown = dx_source.read(spark, f"{tmp_path}/out/dx").filter("map = 'merged/map_agfe_BEN'")
    stored = spark.read.parquet(f"{tmp_path}/out/merged/maps").filter("agfe <> 0")
    assert rows(shown, *IJK, "value") == rows(stored, *IJK, "agfe")
    raw = dx_source.read(spark, f"{tmp_path}/out/dx", keep_zero=True).filter("map = 'sim_0/map_agfe_raw_BEN'").toPandas()["value"]
    assert raw.max() > 0 and (raw == raw.max()).sum() > len(raw) / 2          # voxels never visited are not zeroed
