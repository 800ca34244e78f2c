"""Queries: files written and read back, streams worked off, figure tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxelloom.functions.export import rounded
from voxelloom.operators import energy, hotspots, kinetics
from voxelloom.plans import fixture_maps as fx
from voxelloom.plans.q_kinetics import LAST, MAX_TAU, DT
from voxelloom.plans.registry import KT, query, view
from voxelloom.sources import dcd, dx, dx_source, files, pdb, scripts, tables as t
from voxelloom.spark import cut, ranked, shared_dir
from voxelloom.streaming import occupancy as stream

KEY = ["probe", "label"]


def scratch(spark, name: str) -> str:
    """A fresh folder next to the checkpoints, where all executors can reach it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("dx_roundtrip", ["hist"], """
SELECT probe, i, j, k, n::DOUBLE AS value FROM hist WHERE i < 20 AND j < 20 AND k < 20""")
def dx_roundtrip(spark, root):
    """Each probe's histogram as a DX map, written in one job and read back as lines of text."""
    base = scratch(spark, "dx")
    hist = fx.histogram(spark, root).withColumns({"map": F.concat(F.lit("map_"), "probe"), "value": F.col("n")})
    dx_source.write(hist, base, t.WINDOW, t.GRID)
    back = dx.read(spark, base + "/*.dx")
    return back.select(F.regexp_extract("map", r"map_([A-Z]+)\.dx", 1).alias("probe"), "i", "j", "k", "value")


@query("dx_typed_maps", ["thist"], """
SELECT 'HBD/map_' || probe AS map, i, j, k, n::DOUBLE AS value FROM thist WHERE atype = 'HBD' AND i < 20 AND j < 20 AND k < 20""")
def dx_typed_maps(spark, root):
    """Maps of all probes and types written in one job; only the files of one type are opened again."""
    base = scratch(spark, "dx")
    hist = fx.histogram(spark, root, ("probe", "atype")).select(
        F.concat("atype", F.lit("/map_"), "probe").alias("map"), "i", "j", "k", F.col("n").alias("value"))
    dx_source.write(hist, base, t.WINDOW, t.GRID)
    return dx_source.read(spark, base).filter(F.col("map").startswith("HBD/"))


@query("dx_masks", ["fav"], """
SELECT 'mask_' || probe AS map, i, j, k, 1e0 AS value FROM fav WHERE i < 20 AND j < 20 AND k < 20 UNION ALL
SELECT 'outside_' || p.probe, a.i::INT, b.j::INT, c.k::INT, 5e-1 FROM (SELECT DISTINCT probe FROM fav WHERE i < 20 AND j < 20 AND k < 20) p,
  (SELECT unnest(range(20)) AS i) a, (SELECT unnest(range(20)) AS j) b, (SELECT unnest(range(20)) AS k) c
WHERE NOT EXISTS (SELECT 1 FROM fav f WHERE f.probe = p.probe AND f.i = a.i AND f.j = b.j AND f.k = c.k)""")
def dx_masks(spark, root):
    """Masks as maps of ones, and their complements by a background of one half and zeros where the mask is."""
    base = scratch(spark, "dx")
    mask = cut(fx.favourable(spark, root).filter("i < 20 AND j < 20 AND k < 20").select("probe", "i", "j", "k"))
    rows = mask.select(F.concat(F.lit("mask_"), "probe").alias("map"), "i", "j", "k", F.lit(1.0).alias("value")).unionByName(
        mask.select(F.concat(F.lit("outside_"), "probe").alias("map"), "i", "j", "k", F.lit(0.0).alias("value")))
    rest = mask.select(F.concat(F.lit("outside_"), "probe").alias("map"), F.lit(0.5).alias("background")).distinct()
    dx_source.write(rows, base, t.WINDOW, t.GRID, maps=rest)
    return dx_source.read(spark, base)


@query("dx_labels", ["hot", "hrows"], """
SELECT 'hotspot_labels_' || probe AS map, hot.i, hot.j, hot.k, rank::DOUBLE AS value FROM hot JOIN hrows USING (probe, label)
WHERE i < 20 AND j < 20 AND k < 20""")
def dx_labels(spark, root):
    """Hotspot ranks per voxel as maps."""
    base = scratch(spark, "dx")
    lab = fx.labelled(spark, root)
    painted = hotspots.rank_map(lab, hotspots.summarise(lab, ["probe"], t.GRID), ["probe"])
    dx_source.write(painted.select(F.concat(F.lit("hotspot_labels_"), "probe").alias("map"), "i", "j", "k", F.col("rank").alias("value")),
                    base, t.WINDOW, t.GRID)
    return dx_source.read(spark, base)


@query("dcd_window", ["protein"], """
SELECT CAST(frame AS INT) AS frame, p_atom AS atom_id, round(x + ((p_atom * 3 + frame) % 9 - 4) * 0.125e0, 3) + 0e0 AS x, round(y, 3) + 0e0 AS y, round(z, 3) + 0e0 AS z
FROM (SELECT row_number() OVER (ORDER BY atom_id) - 1 AS p_atom, x, y, z FROM protein), (SELECT unnest(range(50)) AS frame)
WHERE frame BETWEEN 10 AND 35 AND frame % 5 = 0 AND p_atom IN (0, 3, 17, 50, 101, 150)""")
def dcd_window(spark, root):
    """Protein atoms over frames as binary trajectory files; a window of frames, every fifth, and some atoms are read back."""
    base = scratch(spark, "dcd")
    rest = ranked(t.protein(spark, root).select("atom_id", "x", "y", "z"), [], ["atom_id"], "place")
    moving = rest.select((F.col("place") - 1).cast("bigint").alias("atom_id"), "x", "y", "z",
                         F.explode(F.sequence(F.lit(0), F.lit(t.FRAMES - 1))).alias("frame"))
    dcd.write(moving.withColumn("x", F.col("x") + (F.pmod(F.col("atom_id") * 3 + F.col("frame"), F.lit(9)) - 4) * 0.125), base)
    back = dcd.read(spark, base, step=5).filter("frame BETWEEN 10 AND 35").filter(F.col("atom_id").isin(0, 3, 17, 50, 101, 150))
    return back.select("frame", "atom_id", *[rounded(c, 3).alias(c) for c in "xyz"])


@query("checkpoint_roundtrip", ["hot", "hrows"], """
SELECT probe, label, rank, n_voxels, round(agfe_min, 6) + 0e0 AS agfe_min, n AS stored_voxels FROM hrows
JOIN (SELECT probe, label, count(*) AS n FROM hot GROUP BY ALL) USING (probe, label)""")
def checkpoint_roundtrip(spark, root):
    lab = fx.labelled(spark, root)
    base = scratch(spark, "hotspots")
    files.save_checkpoint(hotspots.summarise(lab, ["probe"], t.GRID), lab, base)
    rows, voxels = files.load_checkpoint(spark, base)
    sizes = voxels.groupBy(*KEY).agg(F.count(F.lit(1)).alias("stored_voxels"))
    return rows.join(sizes, KEY).select(*KEY, "rank", "n_voxels", rounded("agfe_min", 6).alias("agfe_min"), "stored_voxels")


@query("hotspot_export", ["hrows", "htop"], """
SELECT probe AS cosolvent, label AS site_id, rank, n_voxels, round(agfe_min, 4) + 0e0 AS agfe_min,
  round(cx, 3) + 0e0 AS centroid_x FROM hrows""")
def hotspot_export(spark, root):
    """The exported tables, read back as one."""
    lab = fx.labelled(spark, root)
    base = scratch(spark, "export")
    table = files.hotspot_table(hotspots.summarise(lab, ["probe"], t.GRID, 25.0))
    files.write_hotspots(table.withColumn("geom_area", F.col("n_voxels")), base)
    schema = ("rank int, site_id int, n_voxels bigint, centroid_x double, centroid_y double, centroid_z double, "
              "agfe_min double, agfe_mean_top_pct double, cosolvent string")
    return files.read_hotspots(spark, base, schema).select(
        "cosolvent", "site_id", "rank", "n_voxels", "agfe_min", "centroid_x")


@query("survival_export", ["curve"], """
SELECT zone, replica, tau, round(sp, 8) AS sp FROM curve""")
def survival_export(spark, root):
    from voxelloom.plans.q_kinetics import curves
    base = scratch(spark, "survival")
    curves(spark, root).write.mode("overwrite").csv(base, header=True)
    back = spark.read.schema("zone string, replica int, tau int, sp double, time_ps double").csv(base, header=True)
    return back.select("zone", "replica", "tau", rounded("sp", 8).alias("sp"))


view("pdbsrc", [], """SELECT p_partkey AS atom_id, p_partkey // 5 AS resid, ['N', 'CA', 'C', 'O', 'CB'][1 + p_partkey % 5] AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'GLY' ELSE 'ALA' END AS resname, CASE WHEN p_partkey // 5 < 200 THEN 'A' ELSE 'B' END AS chain,
  (p_partkey % 97) * 0.25e0 AS x, (p_partkey % 89) * 0.5e0 AS y, -(p_partkey % 83) * 0.125e0 AS z FROM part""")


def _pdb_lines(spark, root):
    rows = t.table(spark, root, "part").selectExpr(
        "p_partkey AS atom_id", "p_partkey div 5 AS resid", "element_at(array('N', 'CA', 'C', 'O', 'CB'), cast(1 + p_partkey % 5 as int)) AS name",
        "CASE WHEN p_partkey % 3 = 0 THEN 'GLY' ELSE 'ALA' END AS resname",
        "CASE WHEN p_partkey div 5 < 200 THEN 'A' ELSE 'B' END AS chain",
        "(p_partkey % 97) * 0.25e0 AS x", "(p_partkey % 89) * 0.5e0 AS y", "-(p_partkey % 83) * 0.125e0 AS z")
    return pdb.to_lines(rows).select("value")


@query("pdb_atoms", ["pdbsrc"], """
SELECT atom_id, name, resname, chain, resid, x, y, z + 0e0 AS z, substring(name, 1, 1) AS element FROM pdbsrc""")
def pdb_atoms(spark, root):
    out = pdb.protein(pdb.atoms(_pdb_lines(spark, root)))
    return out.select("atom_id", "name", "resname", "chain", "resid", "x", "y", (F.col("z") + 0.0).alias("z"), "element")


view("pdbres", ["pdbsrc"], """SELECT *, lag(c) OVER (PARTITION BY chain ORDER BY resid) AS pc FROM (
  SELECT chain, resid, min(atom_id) FILTER (name = 'N') AS n, min(atom_id) FILTER (name = 'CA') AS ca,
    min(atom_id) FILTER (name = 'C') AS c, min(atom_id) FILTER (name = 'O') AS o, min(atom_id) FILTER (name = 'CB') AS cb
  FROM pdbsrc GROUP BY chain, resid)""")


@query("pdb_bonds", ["pdbres"], """
SELECT a, b FROM (SELECT n AS a, ca AS b FROM pdbres UNION ALL SELECT ca, c FROM pdbres UNION ALL SELECT c, o FROM pdbres
  UNION ALL SELECT ca, cb FROM pdbres UNION ALL SELECT pc, n FROM pdbres) WHERE a IS NOT NULL AND b IS NOT NULL""")
def pdb_bonds(spark, root):
    return pdb.bonds(pdb.atoms(_pdb_lines(spark, root)))


@query("contour_level", ["agfe"], """
SELECT probe, round(quantile_cont(v, 0.001), 6) + 0e0 AS level FROM (
  SELECT probe, CASE WHEN agfe < 0 THEN agfe ELSE 0e0 END AS v FROM agfe WHERE i < 20 AND j < 20 AND k < 20 UNION ALL
  SELECT probe, 0e0 FROM (SELECT probe, 8000 - count(*) AS m FROM agfe WHERE i < 20 AND j < 20 AND k < 20 GROUP BY probe),
    LATERAL (SELECT unnest(range(m)))) GROUP BY probe""")
def contour_level(spark, root):
    """Contour level of the displayed maps, whose every other voxel is 0."""
    shown = energy.shown_map(fx.raw(spark, root)).filter("i < 20 AND j < 20 AND k < 20")
    out = scripts.contour_levels(shown, ["probe"], t.N_ACCESSIBLE)
    return out.select("probe", rounded("level", 6).alias("level"))


@query("figure_points", ["hot", "hrows"], """
SELECT probe, rank, label, (i + 0.5e0) * 2.5e0 AS x, (j + 0.5e0) * 2.5e0 AS y, (k + 0.5e0) * 2.5e0 AS z, round(agfe, 6) + 0e0 AS agfe
FROM hot JOIN hrows USING (probe, label) WHERE rank <= 2""".replace("round(agfe,", "round(hot.agfe,"))
def figure_points(spark, root):
    lab = fx.labelled(spark, root)
    out = scripts.cluster_points(lab, hotspots.summarise(lab, ["probe"], t.GRID), t.GRID, 2)
    return out.withColumn("agfe", rounded("agfe", 6))


@query("session_script")
def session_script(spark, root):
    from voxelloom.plans.q_sites import parts, sites
    from voxelloom.operators import scoring
    lab, rows, member = parts(spark, root)
    voxels = sites.site_voxels(lab, member)
    table = scoring.rank(sites.roll_up(rows, member, voxels, t.GRID, rows.select("probe").distinct()))
    hs = rows.join(hotspots.carve_radius(lab, ["probe"], t.GRID), KEY)
    bs = table.join(hotspots.carve_radius(voxels.withColumn("label", F.col("site_id")), [], t.GRID)
                    .withColumnRenamed("label", "site_id"), "site_id")
    return scripts.session_lines(hs, bs, member)


@query("stream_histogram", ["hist"], "SELECT probe, i, j, k, n FROM hist")
def stream_histogram(spark, root):
    """The histogram from a stream of files; must equal the batch one."""
    schema = t.table(spark, root, "lineitem").schema
    atoms = t.probe_atoms(stream.read_table(spark, root, "lineitem", schema))
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    stream.run_to_table(stream.histogram(atoms, ["probe"], t.GRID), out, state)
    return stream.latest_counts(spark, out, ["probe"])


@query("stream_agfe", ["agfe"], "SELECT probe, i, j, k, round(agfe, 6) + 0e0 AS agfe FROM agfe")
def stream_agfe(spark, root):
    out = energy.raw_map(stream_histogram(spark, root), ["probe"], t.FRAMES, t.N_ACCESSIBLE)
    return out.select("probe", "i", "j", "k", rounded("agfe", 6).alias("agfe"))


view("spans", ["presence"], """SELECT zone, replica, mol, CAST(min(frame) AS INT) AS start, CAST(max(frame) AS INT) AS "end" FROM (
  SELECT *, sum(new) OVER (PARTITION BY zone, replica, mol ORDER BY frame) AS run FROM (SELECT *,
    CASE WHEN frame - lag(frame) OVER (PARTITION BY zone, replica, mol ORDER BY frame) <= 1 THEN 0 ELSE 1 END AS new
    FROM (SELECT DISTINCT zone, replica, mol, frame FROM presence))) GROUP BY zone, replica, mol, run""")


def _events(spark, root):
    return stream.read_table(spark, root, "events", t.table(spark, root, "events").schema)


@query("stream_stays", ["spans"], 'SELECT zone, replica, mol, start, "end" FROM spans')
def stream_stays(spark, root):
    out, state = scratch(spark, "stays"), scratch(spark, "state")
    stream.run_to_table(stream.stays(t.presence_of(_events(spark, root))), out, state)
    return stream.settled_stays(spark.read.parquet(out)).select("zone", "replica", "mol", "start", "end")


@query("stream_survival", ["curve"], "SELECT zone, replica, tau, round(sp, 8) AS sp FROM curve")
def stream_survival(spark, root):
    out = kinetics.survival(stream_stays(spark, root), ["zone", "replica"], MAX_TAU, LAST, DT)
    return out.select("zone", "replica", "tau", rounded("sp", 8).alias("sp"))


@query("stream_sessions", ["spans"], """
SELECT zone, replica, mol, start, "end" FROM spans""")
def stream_sessions(spark, root):
    """Stays as session windows over day-long frames."""
    days = t.presence_of(_events(spark, root)).withColumn(
        "day", F.timestamp_seconds(F.lit(1704067200) + F.col("frame") * F.lit(86400)))
    found = stream.sessions(days, "day", ["zone", "replica", "mol"], "25 hours", "60 days")
    out, state = scratch(spark, "sessions"), scratch(spark, "state")
    stream.run_to_table(found, out, state, mode="complete")
    frame = lambda c: ((F.unix_timestamp(c) - F.lit(1704067200)) / F.lit(86400)).cast("int")
    # In complete mode each batch is the whole state; a session only grows, so the longest counts.
    log = spark.read.parquet(out).select("zone", "replica", "mol", frame("first").alias("start"), frame("last").alias("end"))
    return stream.settled_stays(log).select("zone", "replica", "mol", "start", "end")


view("closed", ["spans"], """SELECT * FROM spans WHERE "end" + 3 + 5 <= (SELECT max(frame) + 1 FROM presence)""")
view("closed_at", ["closed"], """SELECT zone, replica, mol, "end", unnest(range(start, "end" + 1)) AS t FROM closed""")


@query("stream_survival_incremental", ["closed_at"], """
SELECT zone, replica, CAST(tau AS INT) AS tau, round(avg(n / n0), 8) + 0e0 AS sp FROM (
  SELECT o.zone, o.replica, o.t, tau, count(*) FILTER (a."end" - a.t >= tau) AS n, count(*)::DOUBLE AS n0
  FROM (SELECT DISTINCT zone, replica, t, unnest(range(0, 5)) AS tau FROM closed_at) o
  JOIN closed_at a ON a.zone = o.zone AND a.replica = o.replica AND a.t = o.t WHERE o.t + tau <= 29 GROUP BY ALL) GROUP BY ALL""")
def stream_survival_incremental(spark, root):
    """Survival of the stays that are over for sure, five frames behind the stream, from counts that each batch adds to."""
    out, state = scratch(spark, "starts"), scratch(spark, "state")
    closed = stream.closed_stays(t.presence_of(_events(spark, root)), late=5)
    stream.run_counts(closed, ["zone", "replica"], MAX_TAU, out, state)
    curve = stream.running_survival(spark.read.parquet(out), ["zone", "replica"], MAX_TAU, LAST, DT)
    return curve.select("zone", "replica", "tau", rounded("sp", 8).alias("sp"))


@query("stream_sessions_appended", ["spans"], """
SELECT zone, replica, mol, start, "end" FROM spans WHERE "end" <= (SELECT max(frame) - 4 FROM presence)""")
def stream_sessions_appended(spark, root):
    """Sessions written once each, when the watermark (two days behind) is past the silence that ends them."""
    days = t.presence_of(_events(spark, root)).withColumn(
        "day", F.timestamp_seconds(F.lit(1704067200) + F.col("frame") * F.lit(86400)))
    found = stream.sessions(days, "day", ["zone", "replica", "mol"], "25 hours", "2 days")
    out, state = scratch(spark, "sessions"), scratch(spark, "state")
    stream.run_to_table(found, out, state, mode="append")
    frame = lambda c: ((F.unix_timestamp(c) - F.lit(1704067200)) / F.lit(86400)).cast("int")
    return spark.read.parquet(out).select("zone", "replica", "mol", frame("first").alias("start"), frame("last").alias("end"))


@query("stream_windowed_counts", [], """
SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start_s, event_type AS zone, count(*) AS n FROM events
GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""")
def stream_windowed_counts(spark, root):
    """Daily counts of the windows the watermark has closed."""
    ev = _events(spark, root).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("zone"))
    out, state = scratch(spark, "windows"), scratch(spark, "state")
    stream.run_to_table(stream.windowed_counts(ev, "ts", ["zone"], "1 day", "2 days"), out, state, mode="append")
    return spark.read.parquet(out).select(F.unix_timestamp("start").alias("start_s"), "zone", "n")
