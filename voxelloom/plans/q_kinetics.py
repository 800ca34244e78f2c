"""Queries: zones, survival curves, metrics, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import thermo
from voxelloom.functions.export import element, joined, point_label, property_label, rounded
from voxelloom.operators import hotspots, kinetics
from voxelloom.plans import fixture_maps as fx
from voxelloom.plans.registry import query, view
from voxelloom.sources import tables as t

LAST, MAX_TAU, DT = 29, 4, 100.0
BY = ["zone", "replica"]

# One zone per supplier; every atom of every frame is tested against those near it.
view("zones", [], """SELECT CAST(s_suppkey AS INT) AS zone_id, (s_suppkey * 7 % 50) * 1e0 AS x,
  (s_suppkey * 11 % 50) * 1e0 AS y, (s_suppkey * 17 % 50) * 1e0 AS z, 3e0 + s_suppkey % 3 AS radius FROM supplier""")
view("inzone", ["positions", "zones"], """
SELECT p.*, zone_id FROM positions p JOIN zones q ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)
  + (p.z - q.z) * (p.z - q.z) <= radius * radius""")


def _survive(src: str, k: int, gap: int, last: int, dt: float = DT) -> str:
    """Oracle text: survival from stays, counted start frame by start frame."""
    return f"""
WITH seen AS (SELECT DISTINCT {src.split('|')[1]}, mol, frame FROM {src.split('|')[0]}),
stay AS (SELECT *, sum(new) OVER (PARTITION BY {src.split('|')[1]}, mol ORDER BY frame) AS run FROM (SELECT *,
  CASE WHEN frame - lag(frame) OVER (PARTITION BY {src.split('|')[1]}, mol ORDER BY frame) <= {gap + 1} THEN 0 ELSE 1 END AS new FROM seen)),
span AS (SELECT {src.split('|')[1]}, mol, min(frame) AS a, max(frame) AS b FROM stay GROUP BY {src.split('|')[1]}, mol, run),
full_ AS (SELECT {src.split('|')[1]}, mol, unnest(range(a, b + 1)) AS f, b FROM span),
n AS (SELECT {src.split('|')[1]}, f, tau, count(*) AS n0, count(*) FILTER (b >= f + tau) AS n1
  FROM full_, (SELECT unnest(range({k + 1})) AS tau) WHERE f + tau <= {last} GROUP BY {src.split('|')[1]}, f, tau)
SELECT {src.split('|')[1]}, CAST(tau AS INT) AS tau, tau * {dt}e0 AS time_ps, avg(n1 / n0) AS sp FROM n
GROUP BY {src.split('|')[1]}, tau"""


view("curve", ["presence"], f"SELECT * FROM ({_survive('presence|zone, replica', MAX_TAU, 0, LAST)})")
view("curve2", ["presence"], f"SELECT * FROM ({_survive('presence|zone, replica', MAX_TAU, 2, LAST)})")
view("curve12", ["presence"], f"SELECT * FROM ({_survive('presence|zone, replica', 12, 0, LAST)})")


def curves(spark, root, gap=0, max_tau=MAX_TAU):
    stays = kinetics.runs(t.presence(spark, root), BY, intermittency=gap)
    return kinetics.survival(stays, BY, max_tau, LAST, DT)


def zones(spark, root):
    return t.table(spark, root, "supplier").selectExpr(
        "cast(s_suppkey as int) AS zone_id", "(s_suppkey * 7 % 50) * 1e0 AS x", "(s_suppkey * 11 % 50) * 1e0 AS y",
        "(s_suppkey * 17 % 50) * 1e0 AS z", "3e0 + s_suppkey % 3 AS radius")


@query("zone_occupancy", ["inzone"], """
SELECT zone_id, probe, count(*) AS n_rows, count(DISTINCT frame) AS n_frames, count(DISTINCT resid) AS n_mols
FROM inzone GROUP BY ALL""")
def zone_occupancy(spark, root):
    return kinetics.zone_counts(t.positions(spark, root), zones(spark, root), ["probe"], "resid", "frame")


@query("residue_zone_occupancy", ["positions", "protein"], """
SELECT zone_id, probe, count(*) AS n_rows FROM positions p JOIN (
  SELECT CAST(resid % 12 AS INT) AS zone_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM protein GROUP BY resid % 12) q
ON (p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy) + (p.z - cz) * (p.z - cz) <= 36e0 GROUP BY ALL""")
def residue_zone_occupancy(spark, root):
    """Zones at the centre of residue lists."""
    atoms = t.protein(spark, root)
    members = atoms.select((F.col("resid") % 12).cast("int").alias("zone_id"), "resid").distinct()
    z = kinetics.residue_zones(atoms, members, 6.0)
    return kinetics.occupancy(t.positions(spark, root), z).groupBy("zone_id", "probe").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("zone_labels", ["zones"], "SELECT zone_id, printf('(%.2f, %.2f, %.2f)', x, y, z) AS zone FROM zones")
def zone_labels(spark, root):
    return zones(spark, root).select("zone_id", point_label().alias("zone"))


@query("survival_curve", ["curve"], "SELECT zone, replica, tau, time_ps, round(sp, 8) AS sp FROM curve")
def survival_curve(spark, root):
    return curves(spark, root).select(*BY, "tau", "time_ps", rounded("sp", 8).alias("sp"))


@query("survival_intermittent", ["curve2"], "SELECT zone, replica, tau, time_ps, round(sp, 8) AS sp FROM curve2")
def survival_intermittent(spark, root):
    return curves(spark, root, gap=2).select(*BY, "tau", "time_ps", rounded("sp", 8).alias("sp"))


@query("survival_zones", ["inzone"], "SELECT zone_id, probe, replica, tau, time_ps, round(sp, 8) AS sp FROM ("
       + _survive("(SELECT zone_id, probe, replica, resid AS mol, frame FROM inzone)|zone_id, probe, replica", 3, 0, 49) + ")")
def survival_zones(spark, root):
    """Survival of probe molecules in spatial zones, every zone, probe and replica in one plan."""
    by = ["zone_id", "probe", "replica"]
    out = kinetics.zone_survival(t.positions(spark, root), zones(spark, root), by[1:], 3, t.FRAMES - 1, DT, mol="resid")
    return out.select(*by, "tau", "time_ps", rounded("sp", 8).alias("sp"))


@query("survival_replica_mean", ["curve"], """
SELECT zone, tau, time_ps, round(avg(sp), 8) AS sp_mean, round(stddev_samp(sp), 8) + 0e0 AS sp_sd, count(sp) AS n_replicas
FROM curve GROUP BY ALL""")
def survival_replica_mean(spark, root):
    out = kinetics.replica_mean(curves(spark, root), ["zone"])
    return out.select("zone", "tau", "time_ps", rounded("sp_mean", 8).alias("sp_mean"),
                      rounded("sp_sd", 8).alias("sp_sd"), "n_replicas")


def _metrics(spark, root):
    return kinetics.metrics(curves(spark, root, max_tau=12), BY)


@query("sp_mrt", ["curve12"], """
SELECT zone, replica, round(sum((sp + prev) / 2 * (time_ps - pt)), 4) AS sp_mrt FROM (
  SELECT *, lag(sp) OVER w AS prev, lag(time_ps) OVER w AS pt FROM curve12
  WINDOW w AS (PARTITION BY zone, replica ORDER BY tau)) GROUP BY ALL""")
def sp_mrt(spark, root):
    return _metrics(spark, root).select(*BY, "sp_mrt")


@query("sp_half_life", ["curve12"], """
SELECT zone, replica, round(lt + (ht - lt) * (0.5e0 - ls) / (hs - ls), 4) AS sp_half_life FROM (
  SELECT zone, replica, min(sp) FILTER (sp >= 0.5) AS hs, max(sp) FILTER (sp < 0.5) AS ls,
    arg_min(time_ps, {'s': sp, 't': -time_ps}) FILTER (sp >= 0.5) AS ht,
    arg_max(time_ps, {'s': sp, 't': -time_ps}) FILTER (sp < 0.5) AS lt FROM curve12 GROUP BY ALL)""")
def sp_half_life(spark, root):
    return _metrics(spark, root).select(*BY, "sp_half_life")


@query("sp_plateau", ["curve12"], """
SELECT zone, replica, round(avg(sp), 4) + 0e0 AS sp_plateau FROM (SELECT *, row_number() OVER (
  PARTITION BY zone, replica ORDER BY tau DESC) AS r, count(*) OVER (PARTITION BY zone, replica) AS n FROM curve12)
WHERE r <= greatest(1, n // 10) GROUP BY ALL""")
def sp_plateau(spark, root):
    return _metrics(spark, root).select(*BY, (F.col("sp_plateau") + 0.0).alias("sp_plateau"))


@query("survival_fit")
def survival_fit(spark, root):
    return kinetics.fits(curves(spark, root, max_tau=12), BY)


@query("survival_fit_curve")
def survival_fit_curve(spark, root):
    return kinetics.fitted_curve(survival_fit(spark, root), BY, 12 * DT)


@query("decay_r2", ["curve12"], """
SELECT zone, replica, round(1 - sum((sp - exp(-time_ps / 150e0)) ** 2) / (var_pop(sp) * count(*)), 6) AS r2
FROM curve12 GROUP BY ALL""")
def decay_r2(spark, root):
    """How much of each curve a decay of 150 ps explains."""
    out = curves(spark, root, max_tau=12).withColumn("fit", thermo.single_decay("time_ps", F.lit(150.0)))
    return out.groupBy(*BY).agg(rounded(thermo.r_squared("sp", "fit"), 6).alias("r2"))


@query("zone_to_site", ["zones", "hrows"], """
SELECT zone_id, probe, rank, round(d, 6) AS distance FROM (SELECT zone_id, probe, rank,
  sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d, row_number() OVER (PARTITION BY zone_id
    ORDER BY sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), probe, rank) AS r FROM zones, hrows) WHERE r = 1 AND d <= 12""")
def zone_to_site(spark, root):
    rows = hotspots.summarise(fx.labelled(spark, root), ["probe"], t.GRID)
    out = kinetics.zone_to_site(zones(spark, root), rows, 12.0, ("probe", "rank"))
    return out.withColumn("distance", rounded("distance", 6))


@query("candidate_zones", ["hrows"], """
SELECT probe, rank - 1 AS zone_id, round(cx, 6) AS x, round(cy, 6) AS y, round(cz, 6) AS z FROM hrows WHERE rank <= 2""")
def candidate_zones(spark, root):
    rows = hotspots.summarise(fx.labelled(spark, root), ["probe"], t.GRID)
    out = kinetics.candidate_zones(rows, 2, 6.0)
    return out.select("probe", "zone_id", *[rounded(c, 6).alias(c) for c in "xyz"])


@query("adaptive_radius", ["positions"], """
SELECT probe, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)) + 1.7e0, 6) AS radius FROM positions p
WHERE frame = 0 AND resid = (SELECT min(resid) FROM positions q WHERE q.probe = p.probe AND frame = 0) GROUP BY probe""")
def adaptive_radius(spark, root):
    out = kinetics.probe_radius(t.positions(spark, root).filter("frame = 0"))
    return out.withColumn("radius", rounded("radius", 6))


@query("element_resolution", ["protein"], """
SELECT element, count(*) AS n_atoms FROM (SELECT CASE WHEN upper(trim(atom_type)) IN ('C','N','O','F','S','P','CL','BR','I','H')
  THEN upper(trim(atom_type)) WHEN upper(substring(trim(atom_type), 1, 1)) IN ('C','N','O','F','S','P','I','H')
  THEN upper(substring(trim(atom_type), 1, 1)) WHEN upper(substring(trim(resname), 1, 1)) IN ('C','N','O','F','S','P','I','H')
  THEN upper(substring(trim(resname), 1, 1)) ELSE 'C' END AS element FROM protein) GROUP BY element""")
def element_resolution(spark, root):
    atoms = t.protein(spark, root).withColumn("element", F.lit(None).cast("string"))
    return atoms.groupBy(element("element", "atom_type", "resname").alias("element")).agg(
        F.count(F.lit(1)).alias("n_atoms"))


@query("site_labels")
def site_labels(spark, root):
    """One line of properties per hotspot, three significant digits each."""
    rows = hotspots.summarise(fx.labelled(spark, root), ["probe"], t.GRID)
    return rows.select("probe", "label", property_label([
        ("rank", F.col("rank"), "plain"), ("agfe", F.col("agfe_min"), "float"),
        ("vol", F.col("n_voxels") * F.lit(t.GRID ** 3), "float")]).alias("text"))


@query("probe_tags", ["positions"], """
SELECT replica, '_' || string_agg(DISTINCT probe, '_' ORDER BY probe) AS tag FROM positions GROUP BY replica""")
def probe_tags(spark, root):
    names = F.sort_array(F.collect_set("probe"))
    return t.positions(spark, root).groupBy("replica").agg(
        F.concat(F.lit("_"), F.array_join(names, "_")).alias("tag"))


@query("ordered_probes", ["positions"], """
SELECT probe, CAST(row_number() OVER (ORDER BY first_frame, probe) AS INT) AS position FROM (
  SELECT probe, min(atom_id) AS first_frame FROM positions GROUP BY probe)""")
def ordered_probes(spark, root):
    """Each probe once, in the order of first appearance."""
    from voxelloom.spark import ranked
    first = t.positions(spark, root).groupBy("probe").agg(F.min("atom_id").alias("f"))
    return ranked(first, [], ["f", "probe"], "position").select("probe", "position")


@query("simulation_lookup", ["positions"], """
SELECT probe, min(replica) AS first_replica, string_agg(DISTINCT replica, ',' ORDER BY replica) AS replicas
FROM positions GROUP BY probe""")
def simulation_lookup(spark, root):
    return t.positions(spark, root).groupBy("probe").agg(
        F.min("replica").alias("first_replica"),
        joined(F.transform(F.sort_array(F.collect_set("replica")), lambda r: r.cast("string"))).alias("replicas"))
