"""Queries: field descriptors, binding sites, scores and dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions.export import joined, rounded, split_list, type_columns_to_map
from voxelloom.functions import chemotypes
from voxelloom.operators import energy, field, hotspots, scoring, sites
from voxelloom.plans import fixture_maps as fx
from voxelloom.plans.q_masks import accessible_to_most
from voxelloom.plans.registry import query, view
from voxelloom.sources import tables as t

KEY = ["probe", "label"]
_BALL = """(SELECT di, dj, dk FROM (SELECT unnest(range(-{r}, {r} + 1))::INT AS di),
  (SELECT unnest(range(-{r}, {r} + 1))::INT AS dj), (SELECT unnest(range(-{r}, {r} + 1))::INT AS dk))"""


def _descr(points: str, keys: str) -> str:
    """Oracle text: descriptors at points (keys, probe, x, y, z) of the shown maps."""
    dist = ("sqrt((({c}i + di) * 2.5e0 + 1.25e0 - x) ** 2 + (({c}j + dj) * 2.5e0 + 1.25e0 - y) ** 2 "
            "+ (({c}k + dk) * 2.5e0 + 1.25e0 - z) ** 2)").format(c="c")
    return f"""SELECT {keys}, min(v) FILTER (d <= 3) AS field_min_ball, avg(v) FILTER (d <= 3) AS field_mean_ball,
  min(v) FILTER (d <= 3) - avg(v) FILTER (d > 3) AS field_contrast,
  (avg(v) FILTER (d > 2 AND d <= 3) - min(v) FILTER (d <= 1.5e0)) / 2.25e0 AS field_sharpness
FROM (SELECT p.*, {dist} AS d, coalesce(m.agfe, 0e0) AS v FROM (SELECT *, CAST(floor(x / 2.5e0) AS INT) AS ci,
    CAST(floor(y / 2.5e0) AS INT) AS cj, CAST(floor(z / 2.5e0) AS INT) AS ck FROM {points}) p,
    {_BALL.format(r=3)} o LEFT JOIN shown m ON m.probe = p.probe AND m.i = ci + di AND m.j = cj + dj AND m.k = ck + dk
  WHERE {dist} <= 5 AND ci + di BETWEEN 0 AND 19 AND cj + dj BETWEEN 0 AND 19 AND ck + dk BETWEEN 0 AND 19)
GROUP BY {keys}"""


view("hdescr", ["hrows", "shown"], _descr(
    "(SELECT probe, label, cx AS x, cy AS y, cz AS z FROM hrows)", "probe, label"))
view("hacc", ["hrows", "accmerged"], f"""
SELECT probe, label, count(m.i) / count(*) AS accessible_fraction FROM (
  SELECT probe, label, CAST(floor(cx / 2.5e0) AS INT) + di AS i, CAST(floor(cy / 2.5e0) AS INT) + dj AS j,
    CAST(floor(cz / 2.5e0) AS INT) + dk AS k FROM hrows, {_BALL.format(r=7)}
  WHERE di * di + dj * dj + dk * dk <= 40.96e0) p LEFT JOIN accmerged m USING (i, j, k)
WHERE p.i BETWEEN 0 AND 19 AND p.j BETWEEN 0 AND 19 AND p.k BETWEEN 0 AND 19 GROUP BY ALL""")

# Sites: 6-connected components of the union of the hotspot masks, numbered in raster order.
view("uvox", ["hot"], "SELECT DISTINCT i, j, k, vid FROM hot")
view("uedge", ["uvox"], """SELECT a.vid AS u, b.vid AS v FROM uvox a JOIN uvox b
  ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1""")


from voxelloom.plans.registry import raw_view  # noqa: E402

raw_view("ureach", ["uedge"], """ureach(u, r) AS (SELECT vid, vid FROM uvox UNION
  SELECT e.v, x.r FROM ureach x JOIN uedge e ON e.u = x.u)""")
view("member", ["hot", "ureach"], """
SELECT probe, label, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS site_id FROM (
  SELECT probe, label, root, row_number() OVER (PARTITION BY probe, label ORDER BY count(*) DESC, root) AS r
  FROM hot JOIN (SELECT u AS vid, min(r) AS root FROM ureach GROUP BY u) USING (vid) GROUP BY probe, label, root)
WHERE r = 1""")
view("svox", ["member"], "SELECT DISTINCT site_id, i, j, k FROM hot JOIN member USING (probe, label)")
view("sroll", ["member", "hrows", "htop", "svox", "hacc"], """
SELECT m.site_id, min(agfe_min) AS agfe_min, min(top) AS agfe_mean_top_pct, count(*) AS n_hotspots,
  string_agg(DISTINCT m.probe, ',' ORDER BY m.probe) AS cosolvents, count(DISTINCT m.probe) AS n_cosolvents,
  string_agg(m.probe || '_' || m.label, ',' ORDER BY m.probe || '_' || m.label) AS member_hotspot_ids,
  sum(abs(agfe_min) * cx) / sum(abs(agfe_min)) AS cx, sum(abs(agfe_min) * cy) / sum(abs(agfe_min)) AS cy,
  sum(abs(agfe_min) * cz) / sum(abs(agfe_min)) AS cz, any_value(vol) AS volume,
  avg(accessible_fraction) AS accessible_fraction,
  count(DISTINCT m.probe) / (SELECT count(DISTINCT probe) FROM agfe) AS probe_coverage
FROM member m JOIN hrows USING (probe, label) JOIN htop USING (probe, label) JOIN hacc USING (probe, label)
JOIN (SELECT site_id, count(*) * 15.625e0 AS vol FROM svox GROUP BY site_id) v ON v.site_id = m.site_id
GROUP BY m.site_id""")
# The extent of the box serves as shape here; the hull has no SQL form.
view("sshape", ["svox"], """SELECT site_id, count(*) / ((max(i) - min(i) + 1) * (max(j) - min(j) + 1)
  * (max(k) - min(k) + 1)) AS extent FROM svox GROUP BY site_id""")
view("stype", ["member", "htype"], """SELECT site_id, probe, atype, min(agfe_type) AS agfe
  FROM htype JOIN member USING (probe, label) GROUP BY ALL""")
view("sclass", ["member"], """
SELECT site_id, list(DISTINCT c) AS classes FROM (SELECT site_id, unnest(CASE probe
  WHEN 'BEN' THEN ['aromatic', 'hydrophobic'] WHEN 'ACT' THEN ['anionic', 'hbond_acceptor']
  ELSE ['aliphatic', 'hbond_donor', 'hbond_acceptor'] END) AS c FROM member) GROUP BY site_id""")
view("sfeat", ["sroll", "sshape", "stype", "sclass"], """
SELECT site_id, agfe_min AS affinity, extent AS shape, accessible_fraction, probe_coverage, volume,
  (SELECT count(DISTINCT atype) FROM stype x WHERE x.site_id = s.site_id)::DOUBLE AS chemotype_diversity,
  len(classes) / 6e0 AS probe_chemotype_coverage
FROM sroll s JOIN sshape USING (site_id) JOIN sclass USING (site_id)""")


def _norm(c: str, low: bool) -> str:
    top = f"max({c}) OVER () - {c}" if low else f"{c} - min({c}) OVER ()"
    return (f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-20 THEN 1e0 ELSE "
            f"({top}) / (max({c}) OVER () - min({c}) OVER ()) END")


_FEATS = ("affinity", "shape", "accessible_fraction", "probe_coverage", "volume", "chemotype_diversity",
          "probe_chemotype_coverage")
view("snorm", ["sfeat"], "SELECT site_id, " + ", ".join(
    f"{_norm(c, c in scoring.LOW_IS_GOOD)} AS {c}" for c in _FEATS) + " FROM sfeat")
view("srank", ["snorm"], """SELECT *, CAST(row_number() OVER (ORDER BY combined DESC, site_id) AS INT) AS rank FROM (
  SELECT site_id, 3e0 * affinity + 3.5e0 * shape + 2e0 * accessible_fraction + 2e0 * probe_coverage AS combined FROM snorm)""")


def parts(spark, root):
    """Labelled voxels, hotspot rows with enclosure, and membership of the fixture."""
    lab = fx.labelled(spark, root)
    rows = hotspots.summarise(lab, ["probe"], t.GRID, 25.0)
    points = rows.select(*KEY, *[F.col(f"centroid_{c}").alias(c) for c in "xyz"])
    acc = field.accessible_fraction(points, accessible_to_most(spark, root), KEY, t.GRID, t.WINDOW)
    return lab, rows.join(acc, KEY), sites.group(lab, t.GRID)


def site_table(spark, root):
    """Sites with their roll-ups, types, and the extent as shape."""
    lab, rows, member = parts(spark, root)
    voxels = sites.site_voxels(lab, member)
    out = sites.roll_up(rows, member, voxels, t.GRID, fx.histogram(spark, root).select("probe").distinct())
    typed = hotspots.per_type(lab, fx.raw(spark, root, ("probe", "atype")), ["probe"], fx.CUTOFF)
    from voxelloom.operators import regions
    box = regions.boxes(voxels, ["site_id"]).select("site_id", F.col("extent").alias("solidity"))
    return out.join(sites.atom_types(typed, member), "site_id", "left").join(box, "site_id"), voxels


@query("field_descriptors", ["hdescr"], """
SELECT probe, label, round(field_min_ball, 6) + 0e0 AS field_min_ball, round(field_mean_ball, 6) + 0e0 AS field_mean_ball,
  round(field_contrast, 6) + 0e0 AS field_contrast, round(field_sharpness, 6) + 0e0 AS field_sharpness FROM hdescr""")
def field_descriptors(spark, root):
    rows = hotspots.summarise(fx.labelled(spark, root), ["probe"], t.GRID)
    points = rows.select(*KEY, *[F.col(f"centroid_{c}").alias(c) for c in "xyz"])
    out = field.descriptors(points, energy.shown_map(fx.raw(spark, root)), KEY, ["probe"], t.GRID, t.WINDOW)
    return out.select(*KEY, *[rounded(c, 6).alias(c) for c in field.DESCRIPTORS])


@query("accessible_fraction", ["hacc"], "SELECT probe, label, round(accessible_fraction, 6) AS accessible_fraction FROM hacc")
def accessible_fraction(spark, root):
    _, rows, _ = parts(spark, root)
    return rows.select(*KEY, rounded("accessible_fraction", 6).alias("accessible_fraction"))


view("fsample", ["sroll", "shown"], _descr(
    "(SELECT site_id, cx AS x, cy AS y, cz AS z, p.probe FROM sroll, (SELECT DISTINCT probe FROM agfe) p)",
    "site_id, probe"))
view("fzz", ["fsample"], "SELECT site_id, " + ", ".join(
    f"CASE WHEN count({d}) OVER w < 2 OR stddev_pop({d}) OVER w <= 0 THEN 0e0 ELSE coalesce({s} * ({d} - avg({d}) OVER w) "
    f"/ stddev_pop({d}) OVER w, 0e0) END AS {n}" for d, n, s in
    ((d, n, "-1" if s < 0 else "1") for d, n, s in field.FUSED)) + " FROM fsample WINDOW w AS (PARTITION BY probe)")


@query("fused_features", ["fzz"], """
SELECT site_id, round(sum(fused_affinity), 6) + 0e0 AS fused_affinity, round(sum(fused_contrast), 6) + 0e0 AS fused_contrast,
  round(sum(fused_sharpness), 6) + 0e0 AS fused_sharpness FROM fzz GROUP BY site_id""")
def fused_features(spark, root):
    lab, rows, member = parts(spark, root)
    maps = energy.shown_map(fx.raw(spark, root))
    table = sites.roll_up(rows, member, sites.site_voxels(lab, member), t.GRID, maps.select("probe").distinct())
    points = table.select("site_id", *[F.col(f"centroid_{c}").alias(c) for c in "xyz"])
    sampled = field.descriptors(field.panel_points(points, maps), maps, ["site_id", "probe"], ["probe"],
                                t.GRID, t.WINDOW)
    out = field.fused(sampled, "site_id", "probe")
    return out.select("site_id", *[rounded(n, 6).alias(n) for _, n, _ in field.FUSED])


@query("site_membership", ["member"], "SELECT probe, label, site_id FROM member")
def site_membership(spark, root):
    return sites.group(fx.labelled(spark, root), t.GRID)


@query("site_groups", ["svox"], "SELECT site_id, i, j, k FROM svox")
def site_groups(spark, root):
    lab = fx.labelled(spark, root)
    return sites.site_voxels(lab, sites.group(lab, t.GRID))


view("wide", ["hot"], """SELECT DISTINCT (h.i + di) AS i, (h.j + dj) AS j, (h.k + dk) AS k,
  ((h.i + di) * 1000 + h.j + dj) * 1000 + h.k + dk AS vid FROM hot h, (SELECT unnest(range(-2, 3)) AS di),
  (SELECT unnest(range(-2, 3)) AS dj), (SELECT unnest(range(-2, 3)) AS dk) WHERE di * di + dj * dj + dk * dk <= 4""")
view("wroot", ["wide"], """SELECT vid, root FROM (WITH RECURSIVE g(vid, root) AS (SELECT vid, vid FROM wide UNION
  SELECT b.vid, g.root FROM g JOIN wide a ON a.vid = g.vid JOIN wide b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1
    AND abs(a.k - b.k) <= 1) SELECT vid, min(root) AS root FROM g GROUP BY vid)""")


@query("site_groups_tolerant", ["hot", "wroot"], """
SELECT probe, label, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS site_id FROM (
  SELECT probe, label, root FROM (SELECT probe, label, root, count(*) AS n FROM hot JOIN wroot USING (vid) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY probe, label ORDER BY n DESC, root) = 1)""")
def site_groups_tolerant(spark, root):
    """Grouping with a bridged gap of ten A."""
    return sites.group(fx.labelled(spark, root), t.GRID, 26, 10.0)


@query("site_rollup", ["sroll"], """
SELECT site_id, n_hotspots, cosolvents, CAST(n_cosolvents AS INT) AS n_cosolvents, member_hotspot_ids,
  round(agfe_min, 4) + 0e0 AS agfe_min, round(agfe_mean_top_pct, 4) + 0e0 AS agfe_mean_top_pct,
  round(cx, 3) AS centroid_x, round(cy, 3) AS centroid_y, round(cz, 3) AS centroid_z, round(volume, 3) AS volume,
  round(accessible_fraction, 4) AS accessible_fraction FROM sroll""")
def site_rollup(spark, root):
    table, _ = site_table(spark, root)
    return table.select(
        "site_id", "n_hotspots", joined("cosolvents").alias("cosolvents"), "n_cosolvents",
        joined("member_hotspot_ids").alias("member_hotspot_ids"), rounded("agfe_min", 4).alias("agfe_min"),
        rounded("agfe_mean_top_pct", 4).alias("agfe_mean_top_pct"),
        *[rounded(f"centroid_{c}", 3).alias(f"centroid_{c}") for c in "xyz"],
        rounded("volume", 3).alias("volume"), rounded("accessible_fraction", 4).alias("accessible_fraction"))


@query("pharmacophore", ["stype"], "SELECT site_id, probe, atype, round(agfe, 4) + 0e0 AS agfe FROM stype")
def pharmacophore(spark, root):
    lab = fx.labelled(spark, root)
    typed = hotspots.per_type(lab, fx.raw(spark, root, ("probe", "atype")), ["probe"], fx.CUTOFF)
    return sites.pharmacophore(typed, sites.group(lab, t.GRID)).withColumn("agfe", rounded("agfe", 4))


@query("probe_coverage", ["sroll"], "SELECT site_id, round(probe_coverage, 6) AS probe_coverage FROM sroll")
def probe_coverage(spark, root):
    table, _ = site_table(spark, root)
    return table.select("site_id", rounded("probe_coverage", 6).alias("probe_coverage"))


@query("chemotype_coverage", ["sclass"], """
SELECT site_id, CAST(len(classes) AS INT) AS n_probe_chemotypes, round(len(classes) / 6e0, 6) AS probe_chemotype_coverage,
  array_to_string(list_filter(['aromatic', 'aliphatic', 'hydrophobic', 'polar', 'hbond_donor', 'hbond_acceptor',
    'anionic', 'cationic'], lambda x: list_contains(classes, x)), ',') AS probe_chemotypes FROM sclass""")
def chemotype_coverage(spark, root):
    table, _ = site_table(spark, root)
    return table.select("site_id", "n_probe_chemotypes",
                        rounded("probe_chemotype_coverage", 6).alias("probe_chemotype_coverage"),
                        joined("probe_chemotypes").alias("probe_chemotypes"))


@query("probe_classes", ["positions"], """
SELECT probe, count(*) AS n_classes FROM (SELECT DISTINCT probe, unnest(CASE probe
  WHEN 'BEN' THEN ['aromatic', 'hydrophobic'] WHEN 'ACT' THEN ['anionic', 'hbond_acceptor']
  ELSE ['aliphatic', 'hbond_donor', 'hbond_acceptor'] END) AS c FROM positions) GROUP BY probe""")
def probe_classes(spark, root):
    spans = chemotypes.of_groups(t.positions(spark, root), ["probe"])
    return spans.select("probe", F.size("probe_chemotypes").cast("bigint").alias("n_classes"))


@query("minmax_features", ["snorm"], "SELECT site_id, " + ", ".join(
    f"round({c}, 6) + 0e0 AS {c}" for c in _FEATS) + " FROM snorm")
def minmax_features(spark, root):
    table, _ = site_table(spark, root)
    out = scoring.normalised(scoring.features(table))
    return out.select("site_id", *[rounded(c, 6).alias(c) for c in _FEATS])


@query("dead_weights", ["sfeat"], """
SELECT feature, weight, why FROM (
  SELECT 'kinetics' AS feature, 1e0 AS weight, 'missing' AS why UNION ALL
  SELECT 'chemotype_diversity', 1e0, CASE WHEN min(chemotype_diversity) = max(chemotype_diversity) THEN 'constant' END FROM sfeat
  UNION ALL SELECT 'affinity', 3e0, CASE WHEN min(affinity) = max(affinity) THEN 'constant' END FROM sfeat
  UNION ALL SELECT 'shape', 3.5e0, CASE WHEN min(shape) = max(shape) THEN 'constant' END FROM sfeat
  UNION ALL SELECT 'accessible_fraction', 2e0, CASE WHEN min(accessible_fraction) = max(accessible_fraction) THEN 'constant' END FROM sfeat
  UNION ALL SELECT 'probe_coverage', 2e0, CASE WHEN min(probe_coverage) = max(probe_coverage) THEN 'constant' END FROM sfeat)
WHERE why IS NOT NULL""")
def dead_weights(spark, root):
    table, _ = site_table(spark, root)
    return scoring.dead_weights(scoring.features(table), {"kinetics": 1.0, "chemotype_diversity": 1.0})


@query("site_scores", ["srank"], "SELECT site_id, round(combined, 4) + 0e0 AS combined FROM srank")
def site_scores(spark, root):
    table, _ = site_table(spark, root)
    out = scoring.score(scoring.features(table))
    return out.select("site_id", rounded("combined", 4).alias("combined"))


@query("site_rank", ["srank", "sroll"], """
SELECT site_id, rank, round(combined, 4) + 0e0 AS combined, cosolvents FROM srank JOIN sroll USING (site_id)""")
def site_rank(spark, root):
    table, _ = site_table(spark, root)
    out = scoring.rank(table)
    return out.select("site_id", "rank", rounded("combined", 4).alias("combined"), joined("cosolvents").alias("cosolvents"))


@query("site_label_map", ["svox", "srank"], """
SELECT i, j, k, min(rank) AS rank FROM svox JOIN srank USING (site_id) GROUP BY ALL""")
def site_label_map(spark, root):
    table, voxels = site_table(spark, root)
    return sites.label_map(voxels, scoring.rank(table))


# A stored table of many sites for re-ranking: one row per part.
view("stored", ["protein"], """
SELECT p_partkey AS site_id, -p_retailprice / 1000e0 AS agfe_min, (p_partkey % 5) / 5e0 AS probe_coverage,
  p_size * 1e0 AS volume, p_retailprice / 2000e0 AS solidity,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 11) * 2e0 END AS residence,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 13) / 13e0 END AS accessible_fraction,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'HBD' ELSE 'Car,HBD' END AS favorable_atomtypes,
  CASE p_size % 3 WHEN 0 THEN 'BEN' WHEN 1 THEN 'ACT' ELSE 'IPA' END AS cosolvent FROM part""")


def stored_sites(spark, root):
    return t.table(spark, root, "part").selectExpr(
        "p_partkey AS site_id", "-p_retailprice / 1000e0 AS agfe_min", "(p_partkey % 5) / 5e0 AS probe_coverage",
        "p_size * 1e0 AS volume", "p_retailprice / 2000e0 AS solidity",
        "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 11) * 2e0 END AS residence",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 13) / 13e0 END AS accessible_fraction",
        "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'HBD' ELSE 'Car,HBD' END AS favorable_atomtypes",
        "CASE p_size % 3 WHEN 0 THEN 'BEN' WHEN 1 THEN 'ACT' ELSE 'IPA' END AS cosolvent")


def _mm(c, low=False):
    return f"coalesce({_norm(c, low)}, 0e0)"


view("rerank", ["stored"], f"""
SELECT *, CAST(row_number() OVER (ORDER BY combined DESC, site_id) AS INT) AS rank FROM (
  SELECT *, round(3e0 * {_mm("agfe_min", True)} + 3.5e0 * {_mm("solidity", True)}
    + CASE WHEN accessible_fraction IS NULL THEN 0e0 ELSE 2e0 * {_mm("accessible_fraction", True)} END
    + 2e0 * {_mm("probe_coverage")} - 1.5e0 * {_mm("volume")}
    + CASE WHEN residence IS NULL THEN 0e0 ELSE {_mm("residence")} END
    + {_mm("len(string_split(nullif(favorable_atomtypes, ''), ','))")}, 9) AS combined FROM stored)""")
# A site without types scores 0 types, not a missing value.
from voxelloom.plans.registry import VIEWS  # noqa: E402

VIEWS["rerank"] = VIEWS["rerank"].replace(
    "len(string_split(nullif(favorable_atomtypes, ''), ','))",
    "coalesce(len(string_split(nullif(favorable_atomtypes, ''), ',')), 0)")


def reranked(spark, root):
    base = stored_sites(spark, root).withColumn("favorable_atomtypes", split_list("favorable_atomtypes"))
    feats = scoring.features(base)
    scored = scoring.score(feats, {"volume": -1.5, "kinetics": 1.0, "chemotype_diversity": 1.0})
    from voxelloom.spark import ranked
    placed = ranked(scored.withColumn("combined", F.round("combined", 9)), [],
                    [F.col("combined").desc(), F.col("site_id")], "rank")
    return base.join(placed, "site_id")


@query("rerank_custom_weights", ["rerank"], "SELECT site_id, round(combined, 6) + 0e0 AS combined, rank FROM rerank")
def rerank_custom_weights(spark, root):
    return reranked(spark, root).select("site_id", rounded("combined", 6).alias("combined"), "rank")


@query("dashboard_top_n", ["rerank"], """
SELECT cosolvent, site_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY cosolvent ORDER BY rank) AS r FROM rerank
  WHERE cosolvent IN ('BEN', 'IPA') AND combined >= 2) WHERE r <= 5""")
def dashboard_top_n(spark, root):
    from pyspark.sql import Window
    rows = reranked(spark, root).filter(F.col("cosolvent").isin("BEN", "IPA") & (F.col("combined") >= 2))
    w = Window.partitionBy("cosolvent").orderBy("rank")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("cosolvent", "site_id", "rank")


@query("dashboard_summary", ["rerank"], """
SELECT count(*) AS n_sites, count(DISTINCT cosolvent) AS n_cosolvents,
  count(*) || ' site(s) across ' || count(DISTINCT cosolvent) || ' cosolvent(s)' AS summary FROM rerank WHERE combined >= 2""")
def dashboard_summary(spark, root):
    out = reranked(spark, root).filter(F.col("combined") >= 2).agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_distinct("cosolvent").alias("n_cosolvents"))
    return out.withColumn("summary", F.format_string("%d site(s) across %d cosolvent(s)", "n_sites", "n_cosolvents"))


@query("site_atomtype_map", ["htype"], """
SELECT probe, label, string_agg(atype || '=' || CAST(CAST(round(agfe_type, 3) AS DECIMAL(10, 3)) AS VARCHAR), ' ' ORDER BY atype) AS types
FROM htype GROUP BY ALL""")
def site_atomtype_map(spark, root):
    """``agfe_<type>`` columns of an exported table, read back into a map."""
    typed = hotspots.per_type(fx.labelled(spark, root), fx.raw(spark, root, ("probe", "atype")), ["probe"], fx.CUTOFF)
    wide = typed.groupBy(*KEY).pivot("atype", ["Car", "HBD"]).agg(F.min("agfe_type"))
    wide = wide.withColumnsRenamed({"Car": "agfe_Car", "HBD": "agfe_HBD"})
    pairs = F.map_entries(type_columns_to_map(wide))
    text = F.transform(F.array_sort(pairs), lambda e: F.concat(
        e["key"], F.lit("="), F.round(e["value"], 3).cast("decimal(10,3)").cast("string")))
    return wide.select(*KEY, F.array_join(text, " ").alias("types"))
