"""The whole analysis of a set of runs: maps, merge, hotspots, kinetics, sites, exports.

All runs and probes go through one plan per stage, as grouping columns.  The positions are read twice:
once for all that does not depend on hotspots, once for zones and superposition (:mod:`voxelloom.operators.scan`).
Each stage is written out once, as the next ones all start from it.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelloom.functions import thermo
from voxelloom.lattice import IJK
from voxelloom.operators import (density, energy, field, hotspots, kinetics, merge, qc, regions, scan, scoring,
                                 sites, stencil)
from voxelloom.plans.config import AnalysisConfig
from voxelloom.sources import dx_source, files, pdb, scripts
from voxelloom.spark import cut, running_total

log = logging.getLogger(__name__)
RUN = ["sim", "probe"]
PROBE_RADIUS, MASK_STRIDE = 1.4, 5


class Analysis:
    """Lazily built stages of one analysis."""

    def __init__(self, spark: SparkSession, config: AnalysisConfig):
        self.spark, self.config = spark, config
        self.gridsize = config.density_maps.gridsize
        self.temperature = config.density_maps.temperature
        self._made: dict[str, object] = {}

    def _once(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    # Input: one table of positions with their atoms, over all runs.
    def atoms(self) -> DataFrame:
        """Atoms of every run with their part in it: ``sim_no, sim, atom_id, name, .., role``."""
        out, read = None, {}
        for n, run in enumerate(self.config.simulations):
            if run.topology not in read:
                read[run.topology] = self.spark.read.parquet(run.topology)
            atoms = read[run.topology]
            if self.config.density_maps.atomtypes_file:        # atom_id, priority, atype: matches of typing rules
                matches = self.spark.read.parquet(self.config.density_maps.atomtypes_file)
                typed = files.assign_types(atoms.select("atom_id"), matches)
                atoms = atoms.drop("atype").join(typed, "atom_id", "left")
            role = (F.when(F.col("resname").isin(run.cosolvents), "probe").when(F.col("resname").isin(pdb.WATER), "water")
                    .when(F.col("resname").isin(pdb.AMINO_ACIDS), "protein").otherwise("other"))
            part = atoms.withColumns({"role": role, "sim": F.lit(run.label or f"sim_{n}"), "sim_no": F.lit(n)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def order(self) -> DataFrame:
        """``sim, sim_no``, a row per run."""
        return self.spark.createDataFrame([(r.label or f"sim_{n}", n) for n, r in enumerate(self.config.simulations)],
                                          "sim string, sim_no int")

    def positions(self) -> DataFrame:
        """One reader over the files of all runs; a file's name says which run it belongs to."""
        def load():
            paths = [run.trajectory for run in self.config.simulations]
            listed = [(f, n) for n, path in enumerate(paths) for f in self.spark.read.parquet(path).inputFiles()]
            # the two interfaces spell local files differently
            of = [(name, n) for f, n in listed for name in dict.fromkeys((f, f.replace("file:///", "file:/", 1)))]
            runs = self.spark.createDataFrame(of, "_file string, sim_no int")
            rows = self.spark.read.option("mergeSchema", "true").parquet(*dict.fromkeys(paths))
            rows = rows.withColumn("_file", F.col("_metadata.file_path")).join(F.broadcast(runs), "_file").drop("_file")
            return rows.join(self.atoms(), ["sim_no", "atom_id"])
        return self._once("positions", load)

    def scanned(self) -> DataFrame:
        """The first pass: all that does not depend on hotspots."""
        return self._once("scanned", lambda: scan.by_kind(scan.accumulate(self.positions(), self.gridsize, MASK_STRIDE)))

    def followed(self) -> DataFrame:
        """The second pass: atoms in zones and the superposition of frames."""
        def build():
            zones = self.zones() if self.has_kinetics() else None
            reference = scan.mean_places(self.scanned(), "CA") if self.config.report.rmsf else None
            return scan.by_kind(scan.follow(self.positions(), zones, reference))
        return self._once("followed", build)

    def panel(self) -> DataFrame:
        """``sim, probe`` for every probe seen in a run."""
        return scan.spans(self.scanned()).select(*RUN)

    def frames(self) -> DataFrame:
        """Box per run and frame; where the runs carry no edges, the span of all atoms serves."""
        return scan.frames(self.scanned())

    def boxes(self) -> DataFrame:
        return self._once("boxes", lambda: cut(density.mean_box(self.frames(), ["sim"])))

    def n_frames(self) -> DataFrame:
        return self._once("n_frames", lambda: cut(self.frames().groupBy("sim").agg(
            F.count(F.lit(1)).cast("double").alias("n_frames"))))

    def extents(self) -> DataFrame:
        return self._once("extents", lambda: cut(density.extent_of(
            scan.spans(self.scanned()), self.frames(), RUN, self.gridsize, ["sim"])))

    def window(self) -> dict:
        return self._once("window", lambda: density.whole_window(self.extents()))

    # Accessible volume.
    def masks(self) -> DataFrame:
        def build():
            of = lambda what: scan.seen(self.scanned(), what)
            solvent = stencil.union(of("water").drop("probe").join(self.panel(), "sim"), of("probe"), RUN)
            self._made["protein"] = cut(of("protein").drop("probe"))
            return cut(stencil.accessible(solvent, self._made["protein"], RUN, self.gridsize, self.window(),
                                          PROBE_RADIUS))
        return self._once("masks", build)

    def accessible_counts(self) -> DataFrame:
        masks = self.masks()
        return self._once("n_accessible", lambda: cut(stencil.accessible_count(
            masks, self._made["protein"], RUN, self.gridsize, self.window(), self.boxes())
            .select(*RUN, F.col("n_accessible").cast("double").alias("n_accessible"))))

    # Maps.
    def types(self) -> list[str]:
        return ["atype"] if self.config.density_maps.use_atomtypes and "atype" in self.positions().columns else []

    def histogram(self) -> DataFrame:
        """Counts per run, probe and type; atoms without a type are left out of typed maps."""
        def count():
            seen = scan.counts(self.scanned())
            if self.types():
                typed = seen.filter(F.col("atype").isNotNull())
                # A run whose atoms match no type at all keeps its plain map.
                some = typed.select(*RUN).distinct()
                plain = seen.join(some, RUN, "left_anti").withColumn("atype", F.lit("total"))
                seen = typed.unionByName(plain)
            by = RUN + self.types()
            return cut(seen.groupBy(*by, *IJK).agg(F.sum("n").alias("n")))
        return self._once("histogram", count)

    def sigma(self) -> float:
        return thermo.sigma_voxels(PROBE_RADIUS, self.gridsize)

    def raw_maps(self) -> DataFrame:
        return energy.raw_map(self.histogram(), RUN + self.types(), self.n_frames(), self.accessible_counts(),
                              self.temperature)

    def maps(self) -> DataFrame:
        """Smoothed maps of every run, favourable voxels only (others read 0)."""
        return self._once("maps", lambda: cut(energy.shown_map(energy.smoothed_map(
            self.histogram(), RUN + self.types(), self.n_frames(), self.accessible_counts(), self.sigma(),
            self.window(), self.temperature))))

    def sampling(self) -> DataFrame:
        totals = energy.totals(self.histogram(), RUN, self.n_frames(), self.accessible_counts())
        return energy.summary_line(energy.sampling_report(
            totals, "n_frames", "n_accessible", self.sigma(), self.config.hotspots.n_kt, self.temperature))

    def merged_typed(self) -> DataFrame:
        """Maps of the same probe and type over the runs that cover each voxel."""
        def build():
            by = ["probe"] + self.types()
            metas = self.extents().withColumn("background", F.lit(0.0))
            if self.types():
                metas = metas.join(self.histogram().select(*RUN, "atype").distinct(), RUN)
            return cut(merge.merge_covered(self.maps(), metas, by, self.config.misc.merge_method,
                                           reference=self.config.misc.merge_resampling_to, map_id="sim"))
        return self._once("merged", build)

    def merged(self) -> DataFrame:
        typed = self.merged_typed()
        return self._once("combined", lambda: cut(energy.combine_types(typed, ["probe"]))) if self.types() else typed

    def merged_mask(self) -> DataFrame:
        """Accessible voxels by majority over all runs and probes."""
        name = F.concat_ws("|", *RUN)
        return self._once("mask", lambda: cut(merge.majority(
            self.masks().withColumn("run", name), self.extents().withColumn("run", name), [], map_id="run")
            .select(*IJK)))

    # Hotspots.
    def labelled(self) -> DataFrame:
        def build():
            cfg = self.config.hotspots.clustering
            fav = self.merged().filter(F.col("agfe") < F.lit(self.config.cutoff()))
            if cfg.use_skimage_cleanup:
                clean = hotspots.clean_mask(fav, ["probe"], self.window(), cfg.cleanup_min_size, cfg.cleanup_hole_size)
                fav = clean.join(self.merged(), ["probe", *IJK], "left").withColumn("agfe", F.coalesce("agfe", F.lit(0.0)))
            strategy = hotspots.strategy(cfg.strategy, self.gridsize, cfg.min_cluster_volume_ang3, **cfg.strategy_kwargs)
            return hotspots.cluster(fav, ["probe"], strategy)
        return self._once("labelled", build)

    def all_hotspots(self) -> DataFrame:
        """Hotspot rows with field descriptors, enclosure, solidity and types, before the shape filter."""
        def build():
            key = ["probe", "label"]
            lab = self.labelled()
            rows = cut(hotspots.summarise(lab, ["probe"], self.gridsize, self.config.hotspots.top_percentile))
            points = rows.select(*key, *[F.col(f"centroid_{c}").alias(c) for c in "xyz"])
            rows = rows.join(field.descriptors(points, self.merged(), key, ["probe"], self.gridsize, self.window()), key)
            rows = rows.join(field.accessible_fraction(points, self.merged_mask(), key, self.gridsize, self.window()), key)
            hull = regions.hulls(lab, key).select(*key, F.col("solidity").alias("geom_solidity"))
            box = regions.boxes(lab, key).select(*key, F.col("extent").alias("geom_extent"))
            rows = rows.join(hull, key, "left").join(box, key)
            if self.types():
                rows = rows.join(hotspots.favourable_types(self.typed_minima(), ["probe"]), key, "left")
            return cut(rows)
        return self._once("all_hotspots", build)

    def typed_minima(self) -> DataFrame:
        return hotspots.per_type(self.labelled(), self.merged_typed(), ["probe"], self.config.cutoff())

    def hotspots(self) -> DataFrame:
        cfg = self.config.hotspots.clustering

        def build():
            rows = hotspots.shape_filter(self.all_hotspots(), cfg.max_solidity, cfg.min_field_sharpness)
            return self.with_kinetics(rows) if self.has_kinetics() else rows
        return self._once("hotspots", build)

    # Kinetics.
    def has_kinetics(self) -> bool:
        kw = self.config.hotspots.survival_kwargs
        loaded = self.config.checkpoint.load_hotspots and "hotspots" in self._made
        if kw.get("sp_zones") is not None:                     # given points count alone; an empty list asks for none
            return not loaded and len(kw["sp_zones"]) > 0
        return not loaded and bool(kw.get("sp_top_n", 5) > 0 or kw.get("zones_csv"))

    def given_zones(self) -> DataFrame | None:
        """``zone_id, x, y, z`` of the points in the settings or in their file, numbered as they stand there."""
        kw = self.config.hotspots.survival_kwargs
        if kw.get("sp_zones") is not None:
            return self.spark.createDataFrame([(n, *map(float, z)) for n, z in enumerate(kw["sp_zones"])],
                                              "zone_id long, x double, y double, z double")
        if not kw.get("zones_csv"):
            return None
        given = files.read_zones(self.spark, kw["zones_csv"]).withColumn("_line", F.monotonically_increasing_id())
        return running_total(given, [], ["_line"], name="zone_id").drop("_line")

    def zones(self) -> DataFrame:
        """``probe, zone_id, x, y, z, radius``: the best hotspots of each probe, or the given zones for all of them."""
        def build():
            kw = self.config.hotspots.survival_kwargs
            rows = hotspots.shape_filter(self.all_hotspots())
            probes = sorted({c for s in self.config.simulations for c in s.cosolvents})
            # a probe is measured in the first frame of the first run that has it
            radius = kinetics.resolve_radius(kw.get("radius", 6.0), scan.first_places(self.scanned(), self.order()),
                                             probes, kw.get("radius_tolerance", 1.7))
            zones = kinetics.candidate_zones(rows, kw.get("sp_top_n", 5), 6.0)
            given = self.given_zones()
            if given is not None:
                names = self.spark.createDataFrame([(p,) for p in probes], "probe string")
                zones = given.join(F.broadcast(names), F.lit(True)).withColumn("radius", F.lit(6.0))
            sizes = self.spark.createDataFrame(list(radius.items()), "probe string, radius double")
            return cut(zones.drop("radius").join(F.broadcast(sizes), "probe").withColumn(
                "zone_id", F.concat_ws("|", "probe", "zone_id")))
        return self._once("zones", build)

    def survival(self) -> DataFrame:
        """Replica-averaged survival curves at the best hotspots of each probe, or at given zones."""
        def build():
            kw = self.config.hotspots.survival_kwargs
            inside = scan.kind(self.followed(), "zone").select("sim", "probe", "frame", "atom_id", "zone_id")
            by = ["probe", "zone_id", "sim"]
            last = self.frames().groupBy("sim").agg(F.max("frame").alias("last_frame"))        # a row per run
            stays = kinetics.runs(inside, by, "atom_id", intermittency=kw.get("intermittency", 0))
            stays = stays.join(F.broadcast(last), "sim")
            dt, notes = kinetics.frame_step([kw.get("trajectory_dt_ps", 0.0)], kw.get("dt_ps"))
            for n in notes:
                log.warning(n)
            curves = kinetics.survival(stays, [*by, "last_frame"], kw.get("max_tau", 100), F.col("last_frame"), dt)
            self._made["curves"] = cut(curves.drop("last_frame"))
            return cut(kinetics.replica_mean(self._made["curves"], ["probe", "zone_id"]))
        return self._once("survival", build)

    def with_kinetics(self, rows: DataFrame) -> DataFrame:
        """Curve metrics and fits put on the hotspots their zones belong to."""
        kw = self.config.hotspots.survival_kwargs
        by = ["probe", "zone_id"]
        curves = self.survival()
        found = kinetics.metrics(curves, by, "sp_mean").join(kinetics.fits(curves, by, "sp_mean"), by, "left")
        if kw.get("sp_zones") is not None or kw.get("zones_csv"):
            at = kinetics.zone_to_site(self._made["zones"].join(curves.select(*by).distinct(), by), rows,
                                       kw.get("zone_match_ang", 4.0), ("probe", "rank"), within=("probe",))
            # of several zones at one hotspot the last of the file speaks for it
            number = F.substring_index("zone_id", "|", -1).cast("bigint")
            at = at.groupBy("probe", "rank").agg(F.max_by("zone_id", number).alias("zone_id"))
            found = found.join(at, by)
        else:
            found = found.withColumn("rank", (F.substring_index("zone_id", "|", -1).cast("int") + 1))
        return cut(rows.join(found.drop("zone_id", "n_points"), ["probe", "rank"], "left"))

    # Sites.
    def sites(self) -> DataFrame:
        def build():
            cfg = self.config.binding_sites
            key = ["probe", "label"]
            rows = self.hotspots()
            lab = self.labelled().join(rows.select(*key), key, "left_semi")
            member = sites.group(lab, self.gridsize, cfg.connectivity, cfg.merge_tolerance_ang)
            voxels = cut(sites.site_voxels(lab, member))
            panel = self.merged().select("probe").distinct()
            out = sites.roll_up(rows, member, voxels, self.gridsize, panel, overrides=cfg.probe_chemotypes)
            out = out.join(sites.shape(voxels), "site_id")
            if self.types():
                typed = cut(self.typed_minima())
                out = out.join(sites.atom_types(typed, member), "site_id", "left")
                self._made["pharmacophore"] = sites.pharmacophore(typed, member)
            points = out.select("site_id", *[F.col(f"centroid_{c}").alias(c) for c in "xyz"])
            sampled = field.descriptors(field.panel_points(points, panel), self.merged(), ["site_id", "probe"], ["probe"],
                                        self.gridsize, self.window())
            out = cut(out.join(field.fused(sampled, "site_id", "probe"), "site_id"))
            scoring.warn_dead_weights(scoring.features(out), cfg.weights)
            self._made["member"], self._made["site_voxels"] = member, voxels
            return scoring.rank(out, cfg.weights)
        return self._once("sites", build)

    # Maps as files.
    def dx_maps(self, ranked: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """All maps, masks and labels as ``map, i, j, k, value``, and every map's name with the value of voxels not stored.

        ``<run>/map_agfe_[<type>_]<probe>``, ``<run>/map_agfe_raw_..``, ``merged/map_agfe_..``, ``merged/accessible_mask``,
        ``merged/hotspot_labels_<probe>`` and ``merged/binding_site_labels``.
        """
        kinds = self.types()
        of = lambda head, *where: F.concat(*[c for w in where for c in (F.col(w), F.lit("/"))], F.lit(head),
                                           *[c for k in kinds for c in (F.col(k), F.lit("_"))], F.col("probe")).alias("map")
        plain = lambda head: F.concat(F.lit(f"merged/{head}_"), "probe").alias("map")
        zero = F.lit(0.0).alias("background")
        panel = self.histogram().select(*RUN, *kinds).distinct()
        parts = [(self.maps().select(of("map_agfe_", "sim"), *IJK, F.col("agfe").alias("value")), panel.select(of("map_agfe_", "sim"), zero))]
        if self.config.density_maps.export_raw:
            totals = energy.totals(self.histogram(), RUN + kinds, self.n_frames(), self.accessible_counts())
            floor = energy.background(totals, "n_frames", "n_accessible", self.temperature)
            parts.append((self.raw_maps().select(of("map_agfe_raw_", "sim"), *IJK, F.col("agfe").alias("value")),
                          floor.select(of("map_agfe_raw_", "sim"), "background")))
        name = F.concat(F.lit("merged/map_agfe_"), *[c for k in kinds for c in (F.col(k), F.lit("_"))], F.col("probe")).alias("map")
        parts.append((self.merged_typed().select(name, *IJK, F.col("agfe").alias("value")), panel.select(name, zero).distinct()))
        probes = panel.select("probe").distinct()
        labels = hotspots.rank_map(self.labelled(), self.hotspots(), ["probe"])
        parts.append((labels.select(plain("hotspot_labels"), *IJK, F.col("rank").alias("value")), probes.select(plain("hotspot_labels"), zero)))
        one = lambda text: F.lit(f"merged/{text}").alias("map")
        parts.append((self.merged_mask().select(one("accessible_mask"), *IJK, F.lit(1.0).alias("value")), None))
        if ranked is not None:
            painted = sites.label_map(self._made["site_voxels"], ranked)
            parts.append((painted.select(one("binding_site_labels"), *IJK, F.col("rank").alias("value")), None))
        rows, names = None, None
        for voxels, maps in parts:
            voxels = voxels.withColumn("value", F.col("value").cast("double"))
            rows = voxels if rows is None else rows.unionByName(voxels)
            names = maps if names is None else names if maps is None else names.unionByName(maps)
        return rows, names

    def write_dx(self, ranked: DataFrame | None) -> None:
        rows, names = self.dx_maps(ranked)
        dx_source.write(rows, os.path.join(self.config.out_path, "dx"), self.window(), self.gridsize, maps=names)

    # Structure checks.
    def structure(self) -> dict[str, DataFrame]:
        """Fluctuation per atom and residue, and deviation per frame after superposition."""
        per_atom = scan.fluctuation(self.scanned())
        fit = qc.decompose(scan.kind(self.followed(), "fit"), ["sim", "frame"])
        return {"rmsf_by_atom": per_atom, "rmsf_by_residue": per_atom.groupBy("sim", "resid").agg(F.avg("rmsf").alias("rmsf")),
                "rmsd_by_frame": fit.select("sim", "frame", "rmsd_fit")}

    def run(self) -> DataFrame:
        """All stages and exports; returns the ranked sites."""
        cfg = self.config
        base = cfg.out_path
        self.sampling().drop("n_positions").write.mode("overwrite").csv(os.path.join(base, "sampling"), header=True)
        if cfg.density_maps.export_raw:
            self.raw_maps().write.mode("overwrite").partitionBy(*RUN).parquet(os.path.join(base, "maps_raw"))
        self.maps().write.mode("overwrite").partitionBy(*RUN).parquet(os.path.join(base, "maps"))
        merged = os.path.join(base, "merged")
        self.merged().write.mode("overwrite").partitionBy("probe").parquet(os.path.join(merged, "maps"))
        self.merged_mask().write.mode("overwrite").parquet(os.path.join(merged, "accessible_mask"))
        store = os.path.join(base, "hotspot_checkpoints")
        if cfg.checkpoint.load_hotspots:
            probes = sorted({c for s in cfg.simulations for c in s.cosolvents})
            self._made["hotspots"], self._made["labelled"] = files.load_checkpoint(self.spark, store, probes)
        elif cfg.checkpoint.save_hotspots:
            files.save_checkpoint(self.hotspots(), self.labelled(), store)
        files.write_hotspots(files.hotspot_table(self.hotspots()), merged)
        if cfg.report.rmsf:
            for name, df in self.structure().items():
                df.write.mode("overwrite").csv(os.path.join(base, name), header=True)
        if "curves" in self._made:
            self._made["curves"].write.mode("overwrite").csv(os.path.join(merged, "survival_per_replica"), header=True)
            self.survival().write.mode("overwrite").csv(os.path.join(merged, "survival"), header=True)
        if not cfg.binding_sites.enabled:
            self.write_dx(None)
            return self.hotspots()
        ranked = cut(self.sites())
        pharm = self._made.get("pharmacophore")
        if pharm is None:
            pharm = ranked.select("site_id")
        files.write_sites(ranked, pharm, sites.label_map(self._made["site_voxels"], ranked), merged)
        self.write_dx(ranked)
        if cfg.pymol.enabled:
            self._session(ranked, merged)
        return ranked

    def _session(self, ranked: DataFrame, folder: str) -> None:
        hs = self.hotspots().join(hotspots.carve_radius(self.labelled(), ["probe"], self.gridsize), ["probe", "label"])
        carve = hotspots.carve_radius(self._made["site_voxels"].withColumn("label", F.col("site_id")), [], self.gridsize)
        bs = ranked.join(carve.withColumnRenamed("label", "site_id"), "site_id")
        lines = scripts.session_lines(hs, bs, self._made["member"], self.config.report.reference_pdb,
                                      self.config.pymol.top_n_sites)
        (lines.repartitionByRange("part", "probe", "rank").sortWithinPartitions("part", "probe", "rank").select("line")
         .write.mode("overwrite").text(os.path.join(folder, "session_pml")))
