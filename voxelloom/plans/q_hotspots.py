"""Queries: components, hotspots, region descriptors, hotspot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import thermo
from voxelloom.functions.export import joined, marker_radius, marker_size, rounded, sphere_radius
from voxelloom.lattice import voxel_key
from voxelloom.operators import components, hotspots, properties, regions, watershed
from voxelloom.plans import fixture_maps as fx
from voxelloom.plans.registry import KT, query, raw_view, view
from voxelloom.sources import tables as t
from voxelloom.spark import cut

KEY = ["probe", "label"]

view("hrows", ["hot"], """
SELECT *, CAST(row_number() OVER (PARTITION BY probe ORDER BY agfe_min, label) AS INT) AS rank FROM (
  SELECT probe, label, count(*) AS n_voxels, min(agfe) AS agfe_min,
    sum(abs(agfe) * (i + 0.5e0) * 2.5e0) / sum(abs(agfe)) AS cx,
    sum(abs(agfe) * (j + 0.5e0) * 2.5e0) / sum(abs(agfe)) AS cy,
    sum(abs(agfe) * (k + 0.5e0) * 2.5e0) / sum(abs(agfe)) AS cz
  FROM hot GROUP BY ALL)""")
view("htop", ["hot"], """
SELECT probe, label, avg(agfe) AS top FROM (SELECT *, row_number() OVER (PARTITION BY probe, label
  ORDER BY agfe, vid) AS r FROM hot) WHERE r <= greatest(1, floor(n_voxels * 25e0 / 100e0)) GROUP BY ALL""")
view("htype", ["hot", "tagfe"], f"""
SELECT h.probe, h.label, t.atype, min(t.agfe) AS agfe_type FROM hot h JOIN tagfe t USING (probe, i, j, k)
GROUP BY ALL HAVING min(t.agfe) < -{KT}""")


def _labels(conn):
    def run(spark, root):
        return components.label(fx.favourable(spark, root), ["probe"], conn)
    return run


for _c in (6, 26):
    query(f"cc_labels_{_c}", [f"lab{_c}"], f"SELECT probe, i, j, k, label, n_voxels FROM lab{_c}")(_labels(_c))


@query("cluster_sizes", ["lab6", "fav"], """
SELECT probe, n_clusters, largest, n_favorable, largest > 0.5e0 * n_favorable AS degenerate FROM (
  SELECT probe, count(DISTINCT label) AS n_clusters, max(n_voxels) AS largest, count(*) AS n_favorable
  FROM lab6 GROUP BY probe)""")
def cluster_sizes(spark, root):
    fav = fx.favourable(spark, root)
    lab = components.label(fav, ["probe"], 6)
    share = hotspots.largest_share(lab, fav, ["probe"])
    return lab.groupBy("probe").agg(F.count_distinct("label").alias("n_clusters")).join(share, "probe")


@query("min_volume_filter", ["lab6"], """
SELECT probe, label, n_voxels, count(*) AS rows FROM lab6 WHERE n_voxels >= greatest(1, round_even(40e0 / 15.625e0, 0))
GROUP BY ALL""")
def min_volume_filter(spark, root):
    """Minimum cluster size given as a volume (40 A^3 at this voxel edge)."""
    lab = components.label(fx.favourable(spark, root), ["probe"], 6, thermo.min_voxels(40.0, t.GRID))
    return lab.groupBy("probe", "label", "n_voxels").agg(F.count(F.lit(1)).alias("rows"))


@query("hotspots", ["hrows", "htop"], """
SELECT probe, label, rank, n_voxels, round(agfe_min, 4) + 0e0 AS agfe_min, round(top, 4) + 0e0 AS agfe_mean_top_pct,
  round(cx, 3) + 0e0 AS centroid_x, round(cy, 3) + 0e0 AS centroid_y, round(cz, 3) + 0e0 AS centroid_z
FROM hrows JOIN htop USING (probe, label)""")
def hotspot_rows(spark, root):
    rows = hotspots.summarise(fx.labelled(spark, root), ["probe"], t.GRID, 25.0)
    return rows.select("probe", "label", "rank", "n_voxels", rounded("agfe_min", 4).alias("agfe_min"),
                       rounded("agfe_mean_top_pct", 4).alias("agfe_mean_top_pct"),
                       *[rounded(f"centroid_{c}", 3).alias(f"centroid_{c}") for c in "xyz"])


@query("hotspot_top_pct", ["htop"], "SELECT probe, label, round(top, 6) + 0e0 AS agfe_mean_top_pct FROM htop")
def hotspot_top_pct(spark, root):
    top = hotspots.top_percent(fx.labelled(spark, root), ["probe"], 25.0)
    return top.select(*KEY, rounded("agfe_mean_top_pct", 6).alias("agfe_mean_top_pct"))


@query("favorable_atomtypes", ["htype"], """
SELECT probe, label, string_agg(atype, ',' ORDER BY atype) AS favorable_atomtypes,
  round(min(agfe_type) FILTER (atype = 'HBD'), 4) + 0e0 AS agfe_hbd,
  round(min(agfe_type) FILTER (atype = 'Car'), 4) + 0e0 AS agfe_car FROM htype GROUP BY ALL""")
def favorable_atomtypes(spark, root):
    typed = hotspots.per_type(fx.labelled(spark, root), fx.raw(spark, root, ("probe", "atype")), ["probe"], fx.CUTOFF)
    rows = hotspots.favourable_types(typed, ["probe"])
    return rows.select(*KEY, joined("favorable_atomtypes").alias("favorable_atomtypes"),
                       rounded(F.col("per_type_agfe")["HBD"], 4).alias("agfe_hbd"),
                       rounded(F.col("per_type_agfe")["Car"], 4).alias("agfe_car"))


@query("hotspot_rank", ["hrows"], "SELECT probe, label, rank FROM hrows")
def hotspot_rank(spark, root):
    return hotspots.summarise(fx.labelled(spark, root), ["probe"], t.GRID).select(*KEY, "rank")


@query("label_map", ["hot", "hrows"], """
SELECT a.probe, a.i, a.j, a.k, coalesce(r.rank, 0) AS rank FROM agfe a
LEFT JOIN hot h ON h.probe = a.probe AND h.i = a.i AND h.j = a.j AND h.k = a.k
LEFT JOIN hrows r ON r.probe = h.probe AND r.label = h.label""")
def label_map(spark, root):
    lab = fx.labelled(spark, root)
    painted = hotspots.rank_map(lab, hotspots.summarise(lab, ["probe"], t.GRID), ["probe"])
    return (fx.raw(spark, root).select("probe", "i", "j", "k").join(painted, ["probe", "i", "j", "k"], "left")
            .withColumn("rank", F.coalesce("rank", F.lit(0))))


@query("hotspots_all_sorted", ["hrows"], """
SELECT probe, label, round(agfe_min, 4) + 0e0 AS agfe_min,
  CAST(row_number() OVER (ORDER BY agfe_min, probe, label) AS INT) AS position FROM hrows""")
def hotspots_all_sorted(spark, root):
    """One table over all probes, most favourable first."""
    from voxelloom.spark import ranked
    rows = hotspots.summarise(fx.labelled(spark, root), ["probe"], t.GRID)
    out = ranked(rows, [], ["agfe_min", "probe", "label"], "position")
    return out.select(*KEY, rounded("agfe_min", 4).alias("agfe_min"), "position")


@query("hotspot_markers", ["hrows"], """
SELECT probe, label, round(greatest(2e0, cbrt(n_voxels) * 0.4e0), 6) AS radius,
  round(least(greatest(cbrt(n_voxels) * 1.8e0, 12e0), 40e0), 6) AS size,
  round(least(n_voxels / 50e0, 4e0), 6) AS sphere FROM hrows""")
def hotspot_markers(spark, root):
    rows = hotspots.summarise(fx.labelled(spark, root), ["probe"], t.GRID)
    return rows.select(*KEY, rounded(marker_radius("n_voxels"), 6).alias("radius"),
                       rounded(marker_size("n_voxels"), 6).alias("size"),
                       rounded(sphere_radius("n_voxels"), 6).alias("sphere"))


@query("carve_radius", ["hot"], """
SELECT probe, label, round(0.5e0 * sqrt(((max(i) - min(i) + 1) * 2.5e0) ** 2 + ((max(j) - min(j) + 1) * 2.5e0) ** 2
  + ((max(k) - min(k) + 1) * 2.5e0) ** 2) + 2e0, 6) AS carve_radius FROM hot GROUP BY ALL""")
def carve_radius(spark, root):
    out = hotspots.carve_radius(fx.labelled(spark, root), ["probe"], t.GRID)
    return out.select(*KEY, rounded("carve_radius", 6).alias("carve_radius"))


@query("region_extent", ["hot"], """
SELECT probe, label, count(*) AS area, min(i) AS bbox_lo_i, min(j) AS bbox_lo_j, min(k) AS bbox_lo_k,
  CAST(max(i) + 1 AS INT) AS bbox_hi_i, CAST(max(j) + 1 AS INT) AS bbox_hi_j, CAST(max(k) + 1 AS INT) AS bbox_hi_k,
  CAST((max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1) AS BIGINT) AS area_bbox,
  round(count(*) / ((max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1)), 6) AS extent,
  round(pow(6e0 * count(*) / pi(), 1e0 / 3e0), 6) AS equivalent_diameter_area FROM hot GROUP BY ALL""")
def region_extent(spark, root):
    out = regions.boxes(fx.labelled(spark, root), KEY)
    return out.withColumns({c: rounded(c, 6) for c in ("extent", "equivalent_diameter_area")})


_RAW = ", ".join(f"CAST(sum(CAST(i - li AS DOUBLE) ** {p} * CAST(j - lj AS DOUBLE) ** {q} "
                 f"* CAST(k - lk AS DOUBLE) ** {r}) AS DOUBLE) AS m_{p}{q}{r}" for p, q, r in regions.POWERS)
view("hlocal", ["hot"], """
SELECT *, min(i) OVER w AS li, min(j) OVER w AS lj, min(k) OVER w AS lk, avg(i) OVER w AS ci, avg(j) OVER w AS cj,
  avg(k) OVER w AS ck, sum(-agfe * i) OVER w / sum(-agfe) OVER w AS wi, sum(-agfe * j) OVER w / sum(-agfe) OVER w AS wj,
  sum(-agfe * k) OVER w / sum(-agfe) OVER w AS wk FROM hot WINDOW w AS (PARTITION BY probe, label)""")


@query("region_moments", ["hlocal"], f"SELECT probe, label, {_RAW} FROM hlocal GROUP BY ALL")
def region_moments(spark, root):
    return regions.moments(fx.labelled(spark, root), KEY)


_LOW = [p for p in regions.POWERS if sum(p) <= 3]


def _mu(p, q, r, w="1e0", c="c"):
    return f"sum({w} * (i - {c}i) ** {p} * (j - {c}j) ** {q} * (k - {c}k) ** {r})"


@query("region_central_moments", ["hlocal"], "SELECT probe, label, " + ", ".join(
    f"round({_mu(*p)}, 6) + 0e0 AS mu_{p[0]}{p[1]}{p[2]}" for p in _LOW) + ", " + ", ".join(
    f"round({_mu(*p)} / pow(count(*), {sum(p)} / 3e0 + 1), 6) + 0e0 AS nu_{p[0]}{p[1]}{p[2]}"
    for p in _LOW if sum(p) >= 2) + " FROM hlocal GROUP BY ALL")
def region_central_moments(spark, root):
    central = regions.central_moments(fx.labelled(spark, root), KEY, powers=_LOW)
    nu = regions.normalised(central, KEY, _LOW)
    out = central.join(nu, KEY)
    return out.select(*KEY, *[rounded(c, 6).alias(c) for c in central.columns if c.startswith("mu_")],
                      *[rounded(f"nu_{p}{q}{r}", 6).alias(f"nu_{p}{q}{r}") for p, q, r in _LOW if p + q + r >= 2])


@query("region_weighted_moments", ["hlocal"], "SELECT probe, label, " + ", ".join(
    f"round({_mu(*p, w='-agfe', c='w')}, 6) + 0e0 AS mu_{p[0]}{p[1]}{p[2]}" for p in _LOW)
    + ", " + ", ".join(
    f"round(sum(-agfe * (i - li) ** {p} * (j - lj) ** {q} * (k - lk) ** {r}), 6) + 0e0 AS m_{p}{q}{r}"
    for p, q, r in _LOW) + " FROM hlocal GROUP BY ALL")
def region_weighted_moments(spark, root):
    lab = fx.labelled(spark, root)
    central = regions.central_moments(lab, KEY, -F.col("agfe"), _LOW)
    out = central.join(regions.moments(lab, KEY, -F.col("agfe"), _LOW), KEY)
    return out.select(*KEY, *[rounded(c, 6).alias(c) for c in out.columns if c not in KEY])


@query("region_intensity", ["hlocal"], """
SELECT probe, label, round(max(-agfe), 6) AS intensity_max, round(avg(-agfe), 6) AS intensity_mean,
  round(min(-agfe), 6) AS intensity_min, round(stddev_pop(-agfe), 6) AS intensity_std,
  round(any_value(wi), 6) AS centroid_weighted_i, round(any_value(wj), 6) AS centroid_weighted_j,
  round(any_value(wk), 6) AS centroid_weighted_k, round(any_value(wi) - any_value(li), 6) + 0e0 AS centroid_weighted_local_i,
  round(any_value(wj) - any_value(lj), 6) + 0e0 AS centroid_weighted_local_j,
  round(any_value(wk) - any_value(lk), 6) + 0e0 AS centroid_weighted_local_k FROM hlocal GROUP BY ALL""")
def region_intensity(spark, root):
    lab = fx.labelled(spark, root)
    score = F.greatest(-F.col("agfe"), F.lit(0.0))
    out = regions.intensity(lab, KEY, score).join(
        regions.centroids(lab, KEY, score, "centroid_weighted"), KEY)
    return out.select(*KEY, *[rounded(c, 6).alias(c) for c in out.columns if c not in KEY])


@query("region_inertia", ["hlocal"], f"""
SELECT probe, label, round(({_mu(0, 2, 0)} + {_mu(0, 0, 2)}) / count(*), 6) AS inertia_ii,
  round(({_mu(2, 0, 0)} + {_mu(0, 0, 2)}) / count(*), 6) AS inertia_jj,
  round(({_mu(2, 0, 0)} + {_mu(0, 2, 0)}) / count(*), 6) AS inertia_kk,
  round(-{_mu(1, 1, 0)} / count(*), 6) + 0e0 AS inertia_ij, round(-{_mu(1, 0, 1)} / count(*), 6) + 0e0 AS inertia_ik,
  round(-{_mu(0, 1, 1)} / count(*), 6) + 0e0 AS inertia_jk FROM hlocal GROUP BY ALL""")
def region_inertia(spark, root):
    out = regions.inertia(regions.central_moments(fx.labelled(spark, root), KEY, powers=_LOW), KEY)
    return out.select(*KEY, *[rounded(c, 6).alias(c) for c in out.columns if c not in KEY])


@query("region_euler", ["hot"], """
SELECT probe, label, CAST(sum(CASE WHEN (abs(ci % 2) + abs(cj % 2) + abs(ck % 2)) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT)
  AS euler_number FROM (SELECT DISTINCT probe, label, 2 * i + 1 + di AS ci, 2 * j + 1 + dj AS cj, 2 * k + 1 + dk AS ck
  FROM hot, (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj), (SELECT unnest([-1, 0, 1]) AS dk))
GROUP BY ALL""")
def region_euler(spark, root):
    return regions.euler(fx.labelled(spark, root), KEY)


@query("region_properties_selected", ["hlocal"], f"""
SELECT probe, label, count(*) AS area, round(count(*) / ((max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1)), 6) AS extent,
  round(avg(j), 6) AS centroid_j, round(avg(k) - min(k), 6) AS local_k, round(any_value(wi), 6) AS weighted_i,
  round(({_mu(0, 2, 0)} + {_mu(0, 0, 2)}) / count(*), 6) AS inertia_ii, round(-{_mu(1, 0, 1)} / count(*), 6) + 0e0 AS inertia_ik,
  round(({_mu(2, 0, 0)} + {_mu(0, 2, 0)} + {_mu(0, 0, 2)}) * 2e0 / count(*), 6) AS trace, round(stddev_pop(-agfe), 6) AS intensity_std
FROM hlocal GROUP BY ALL""")
def region_properties_selected(spark, root):
    """Some properties by name from one grouping; the eigenvalues sum to the trace of the tensor."""
    out = properties.measure(fx.labelled(spark, root), KEY, ["area", "extent", "centroid", "centroid_local", "centroid_weighted",
                                                             "inertia_tensor", "inertia_tensor_eigvals", "intensity_std"])
    g = lambda name, at=None: F.col(f"geom_{name}") if at is None else F.col(f"geom_{name}")[at]
    return out.select(*KEY, g("area").alias("area"), rounded(g("extent"), 6).alias("extent"), rounded(g("centroid", 1), 6).alias("centroid_j"),
                      rounded(g("centroid_local", 2), 6).alias("local_k"), rounded(g("centroid_weighted", 0), 6).alias("weighted_i"),
                      rounded(g("inertia_tensor", 0), 6).alias("inertia_ii"), rounded(g("inertia_tensor", 2), 6).alias("inertia_ik"),
                      rounded(g("inertia_tensor_eigvals", 0) + g("inertia_tensor_eigvals", 1) + g("inertia_tensor_eigvals", 2), 6).alias("trace"),
                      rounded(g("intensity_std"), 6).alias("intensity_std"))


@query("region_property_custom", ["hot"], """
SELECT probe, label, count(*) AS geom_area, round(max(agfe) - min(agfe), 6) AS geom_relief, count(*) FILTER (agfe < -1.2e0) AS geom_deep,
  CAST(max(i) - min(i) + max(j) - min(j) + max(k) - min(k) + 3 AS INT) AS geom_span FROM hot GROUP BY ALL""")
def region_property_custom(spark, root):
    """Own aggregates beside a known property."""
    relief = (F.max("agfe") - F.min("agfe"))
    span = sum(((F.max(a) - F.min(a)) for a in "ijk"), F.lit(3)).cast("int")
    out = properties.measure(fx.labelled(spark, root), KEY, ["area"], {
        "relief": relief, "deep": F.count_if(F.col("agfe") < -1.2), "span": span})
    return out.withColumn("geom_relief", rounded("geom_relief", 6))


@query("property_serialised", ["hot"], """
SELECT probe, label, '{"geom_area":' || count(*) || ',"geom_bbox":[' || min(i) || ',' || min(j) || ',' || min(k) || ',' || max(i) + 1 || ','
  || max(j) + 1 || ',' || max(k) + 1 || '],"geom_slice":[[' || min(i) || ',' || max(i) + 1 || ',null],[' || min(j) || ',' || max(j) + 1
  || ',null],[' || min(k) || ',' || max(k) + 1 || ',null]],"geom_far":null}' AS properties FROM hot GROUP BY ALL""")
def property_serialised(spark, root):
    """Numbers, lists and slices as text; an infinite value reads null."""
    out = properties.measure(fx.labelled(spark, root), KEY, ["area", "bbox", "slice"], {"far": F.max(F.lit(float("inf")))})
    return properties.serialised(out, KEY)


view("padded", ["hot"], """SELECT probe, label, min(i) - 1 AS li, max(i) + 1 AS hi, min(j) - 1 AS lj, max(j) + 1 AS hj, min(k) - 1 AS lk,
  max(k) + 1 AS hk FROM hot GROUP BY ALL""")
view("empty", ["padded"], """SELECT c.* FROM (SELECT *, unnest(range(lk, hk + 1)) AS k FROM (SELECT *, unnest(range(lj, hj + 1)) AS j FROM (
    SELECT *, unnest(range(li, hi + 1)) AS i FROM padded))) c
  WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE h.probe = c.probe AND h.label = c.label AND h.i = c.i AND h.j = c.j AND h.k = c.k)""")
raw_view("open_cell", ["empty"], """open_cell(probe, label, i, j, k) AS (SELECT probe, label, i, j, k FROM empty
    WHERE i IN (li, hi) OR j IN (lj, hj) OR k IN (lk, hk) UNION
  SELECT e.probe, e.label, e.i, e.j, e.k FROM open_cell o JOIN empty e ON e.probe = o.probe AND e.label = o.label
    AND abs(e.i - o.i) <= 1 AND abs(e.j - o.j) <= 1 AND abs(e.k - o.k) <= 1)""")


@query("region_filled", ["padded", "open_cell"], """
SELECT probe, label, CAST(any_value((hi - li + 1) * (hj - lj + 1) * (hk - lk + 1)) - count(*) AS BIGINT) AS area_filled
FROM padded JOIN open_cell USING (probe, label) GROUP BY probe, label""")
def region_filled(spark, root):
    return regions.filled_area(fx.labelled(spark, root), KEY)


view("tensor", ["hlocal"], f"""SELECT probe, label, ({_mu(0, 2, 0)} + {_mu(0, 0, 2)}) / count(*) AS a, ({_mu(2, 0, 0)} + {_mu(0, 0, 2)}) / count(*) AS b,
  ({_mu(2, 0, 0)} + {_mu(0, 2, 0)}) / count(*) AS c, -{_mu(1, 1, 0)} / count(*) AS d, -{_mu(1, 0, 1)} / count(*) AS e,
  -{_mu(0, 1, 1)} / count(*) AS f FROM hlocal GROUP BY ALL""")
view("eigen", ["tensor"], """SELECT probe, label, e1, 3e0 * q - e1 - e3 AS e2, e3 FROM (
  SELECT *, q + 2e0 * p * cos(acos(r) / 3e0) AS e1, q + 2e0 * p * cos(acos(r) / 3e0 + 2e0 * pi() / 3e0) AS e3 FROM (
    SELECT *, greatest(-1e0, least(1e0, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e))
      / (2e0 * p * p * p))) AS r FROM (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2e0 * (d * d + e * e + f * f)) / 6e0) AS p
        FROM (SELECT *, (a + b + c) / 3e0 AS q FROM tensor))))""")


@query("region_axes", ["eigen"], """
SELECT probe, label, round(e1, 5) + 0e0 AS eig_1, round(e2, 5) + 0e0 AS eig_2, round(e3, 5) + 0e0 AS eig_3,
  round(sqrt(10e0 * greatest(0e0, e1 + e2 - e3)), 5) + 0e0 AS axis_major_length,
  round(sqrt(10e0 * greatest(0e0, e2 + e3 - e1)), 5) + 0e0 AS axis_minor_length FROM eigen""")
def region_axes(spark, root):
    central = regions.central_moments(fx.labelled(spark, root), KEY, powers=_LOW)
    out = regions.axes(regions.inertia(central, KEY), KEY)
    return out.select(*KEY, *[rounded(c, 5).alias(c) for c in out.columns if c not in KEY])


@query("region_hull")
def region_hull(spark, root):
    return regions.hulls(fx.labelled(spark, root), KEY)


@query("shape_filter", ["hot"], """
SELECT probe, label, round(v, 6) AS geom_solidity FROM (SELECT probe, label, CASE WHEN label % 4 = 0 THEN NULL ELSE
  count(*) / ((max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1)) END AS v FROM hot GROUP BY probe, label)
WHERE v IS NULL OR v <= 0.6e0""")
def shape_filter(spark, root):
    """Filter on a shape share that is missing for some hotspots (those stay)."""
    rows = regions.boxes(fx.labelled(spark, root), KEY).withColumn(
        "geom_solidity", F.when(F.col("label") % 4 != 0, F.col("extent")))
    kept = hotspots.shape_filter(rows, max_solidity=0.6)
    return kept.select(*KEY, rounded("geom_solidity", 6).alias("geom_solidity"))


@query("column_split", ["hot"], "SELECT probe, label, count(*) AS geom_area FROM hot GROUP BY ALL")
def column_split(spark, root):
    """The geometry sidecar: keys and the ``geom_`` columns only."""
    lab = fx.labelled(spark, root)
    rows = hotspots.summarise(lab, ["probe"], t.GRID).withColumn("geom_area", F.col("n_voxels"))
    return hotspots.only_prefix(rows, KEY)


@query("voxel_sample", ["hot"], "SELECT probe, label, least(count(*), 10) AS n_rows FROM hot GROUP BY ALL")
def voxel_sample(spark, root):
    """At most ten voxels per hotspot for a figure; which ones is up to a hash."""
    out = hotspots.sample_voxels(fx.labelled(spark, root), ["probe"], 10)
    return out.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"))


@query("clean_mask", ["lab6"], """
SELECT probe, i, j, k FROM lab6 WHERE n_voxels > 1 UNION SELECT e.probe, e.i, e.j, e.k FROM (
  SELECT f.probe, f.i + di AS i, f.j + dj AS j, f.k + dk AS k, count(*) AS c FROM (SELECT * FROM lab6 WHERE n_voxels > 1) f,
   (SELECT di, dj, dk FROM (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj),
    (SELECT unnest([-1, 0, 1]) AS dk) WHERE abs(di) + abs(dj) + abs(dk) = 1) GROUP BY ALL) e
  WHERE c = (CASE WHEN i IN (0, 19) THEN 1 ELSE 2 END) + (CASE WHEN j IN (0, 19) THEN 1 ELSE 2 END)
    + (CASE WHEN k IN (0, 19) THEN 1 ELSE 2 END) AND i BETWEEN 0 AND 19 AND j BETWEEN 0 AND 19 AND k BETWEEN 0 AND 19""")
def clean_mask(spark, root):
    return hotspots.clean_mask(fx.favourable(spark, root), ["probe"], t.WINDOW, min_size=1, hole_size=1)


view("peak", ["edges26"], """SELECT * FROM fav f WHERE NOT EXISTS (
  SELECT 1 FROM edges26 e JOIN fav g ON g.probe = e.probe AND g.vid = e.v WHERE e.probe = f.probe AND e.u = f.vid
    AND (g.agfe < f.agfe OR (g.agfe = f.agfe AND g.vid < f.vid)))""")
# The best way from each voxel to each other one: the highest that the lowest place on the way can be.
raw_view("way", ["edges26"], """way(probe, src, v, m) AS (SELECT probe, vid, vid, -agfe FROM fav UNION
  SELECT w.probe, w.src, e.v, least(w.m, -g.agfe) FROM way w JOIN edges26 e ON e.probe = w.probe AND e.u = w.v
    JOIN fav g ON g.probe = e.probe AND g.vid = e.v)""")
view("higher", ["way"], """SELECT w.probe, w.src AS vid, max(w.m) AS key FROM way w JOIN fav s ON s.probe = w.probe AND s.vid = w.src
  JOIN fav g ON g.probe = w.probe AND g.vid = w.v WHERE g.agfe < s.agfe GROUP BY ALL""")
view("hmax", ["higher"], """SELECT probe, i, j, k, vid FROM fav LEFT JOIN higher USING (probe, vid) JOIN (
  SELECT probe, least(0e0, max(-agfe) - 0.5e0 - max(-agfe) * 2e-15) AS floor FROM fav GROUP BY probe) USING (probe)
WHERE -agfe - greatest(coalesce(key, floor), floor) >= 0.5e0""")
view("shell", ["fav"], """SELECT DISTINCT f.probe, f.i + di AS i, f.j + dj AS j, f.k + dk AS k FROM fav f, (
    SELECT unnest([1, -1, 0, 0, 0, 0]) AS di, unnest([0, 0, 1, -1, 0, 0]) AS dj, unnest([0, 0, 0, 0, 1, -1]) AS dk)
  WHERE NOT EXISTS (SELECT 1 FROM fav g WHERE g.probe = f.probe AND g.i = f.i + di AND g.j = f.j + dj AND g.k = f.k + dk)""")
view("dmap", ["shell"], """SELECT f.probe, f.i, f.j, f.k, f.vid,
    sqrt(min((f.i - s.i) * (f.i - s.i) + (f.j - s.j) * (f.j - s.j) + (f.k - s.k) * (f.k - s.k))) AS dist
  FROM fav f JOIN shell s USING (probe) GROUP BY ALL""")
view("spot", ["dmap"], """SELECT *, CAST(row_number() OVER (PARTITION BY probe ORDER BY
    (CAST(i AS BIGINT) * 73856093 + CAST(j AS BIGINT) * 19349663 + CAST(k AS BIGINT) * 83492791) % 2147483647, vid) AS INT) AS o
  FROM dmap a WHERE NOT EXISTS (SELECT 1 FROM dmap b WHERE b.probe = a.probe AND b.dist > a.dist
    AND abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3 AND abs(a.k - b.k) <= 3)""")
view("spots", ["spot"], """SELECT a.probe, a.o, coalesce(list(b.o) FILTER (b.o IS NOT NULL), []) AS near FROM spot a LEFT JOIN spot b
  ON b.probe = a.probe AND b.o < a.o AND abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3 AND abs(a.k - b.k) <= 3 GROUP BY ALL""")
raw_view("stay", ["spots"], """stay(probe, o, kept) AS (SELECT DISTINCT probe, 0, CAST([] AS INT[]) FROM spots UNION ALL
  SELECT x.probe, s.o, CASE WHEN list_has_any(x.kept, s.near) THEN x.kept ELSE list_append(x.kept, s.o) END
  FROM stay x JOIN spots s ON s.probe = x.probe AND s.o = x.o + 1)""")
view("apart", ["stay", "spot"], """SELECT s.probe, s.i, s.j, s.k, s.vid FROM spot s JOIN (
  SELECT probe, unnest(kept) AS o FROM (SELECT * FROM stay QUALIFY row_number() OVER (PARTITION BY probe ORDER BY o DESC) = 1)) USING (probe, o)""")


def _flooded(name: str, seeds: str, level: str, needs: list[str]) -> str:
    """Views of a flood from the 6-connected parts of *seeds* over ``(probe, vid, g)``; the last has the labelled voxels.

    Edges are taken from the lowest on; one joins its ends unless both belong to markers.
    """
    raw_view(f"{name}_reach", [seeds, "edges6"], f"""{name}_reach(probe, u, r) AS (SELECT probe, vid, vid FROM {seeds} UNION
  SELECT x.probe, e.v, x.r FROM {name}_reach x JOIN edges6 e ON e.probe = x.probe AND e.u = x.u
    JOIN {seeds} s ON s.probe = e.probe AND s.vid = e.v)""")
    view(f"{name}_mark", [f"{name}_reach"], f"""SELECT probe, vid, dense_rank() OVER (PARTITION BY probe ORDER BY root) AS mark
  FROM (SELECT probe, u AS vid, min(r) AS root FROM {name}_reach GROUP BY ALL)""")
    view(f"{name}_node", [f"{name}_mark", *needs], f"""SELECT l.probe, l.vid, l.g, row_number() OVER (PARTITION BY l.probe ORDER BY l.vid) AS x, m.mark
  FROM ({level}) l LEFT JOIN {name}_mark m USING (probe, vid)""")
    view(f"{name}_edge", [f"{name}_node", "edges6"], f"""SELECT e.probe, a.x AS a, b.x AS b, row_number() OVER (
    PARTITION BY e.probe ORDER BY greatest(a.g, b.g), least(a.g, b.g), e.u, e.v) AS r FROM edges6 e
  JOIN {name}_node a ON a.probe = e.probe AND a.vid = e.u JOIN {name}_node b ON b.probe = e.probe AND b.vid = e.v WHERE e.u < e.v""")
    raw_view(f"{name}_join", [f"{name}_edge"], f"""{name}_join(probe, r, part) AS (
  SELECT probe, CAST(0 AS BIGINT), list(coalesce(-CAST(mark AS BIGINT), x) ORDER BY x) FROM {name}_node GROUP BY probe UNION ALL
  SELECT s.probe, s.r + 1, CASE WHEN s.pa = s.pb OR (s.pa < 0 AND s.pb < 0) THEN s.part
      ELSE list_transform(s.part, lambda p: CASE WHEN p = s.pa OR p = s.pb THEN least(s.pa, s.pb) ELSE p END) END
  FROM (SELECT j.probe, j.r, j.part, j.part[e.a] AS pa, j.part[e.b] AS pb FROM {name}_join j
    JOIN {name}_edge e ON e.probe = j.probe AND e.r = j.r + 1) s)""")
    view(f"{name}_done", [f"{name}_join"], f"""SELECT probe, unnest(part) AS p, unnest(range(1, len(part) + 1)) AS x FROM (
  SELECT * FROM {name}_join QUALIFY row_number() OVER (PARTITION BY probe ORDER BY r DESC) = 1)""")
    return f"""SELECT probe, i, j, k, CAST(-p AS INT) AS label, n_voxels FROM (
  SELECT d.probe, f.i, f.j, f.k, d.p, count(*) OVER (PARTITION BY d.probe, d.p) AS n_voxels FROM {name}_done d
  JOIN {name}_node n ON n.probe = d.probe AND n.x = d.x JOIN fav f ON f.probe = n.probe AND f.vid = n.vid WHERE d.p < 0)
WHERE n_voxels >= 8"""


@query("peak_persistence", ["peak", "higher"], """
SELECT probe, i, j, k, round(-agfe, 6) + 0e0 AS height, round(key, 6) + 0e0 AS saddle, round(-agfe - coalesce(key, 0e0), 6) + 0e0 AS persistence
FROM peak LEFT JOIN higher USING (probe, vid)""")
def peak_persistence(spark, root):
    """How far each local peak of the score stands over the pass to higher ground."""
    score = fx.favourable(spark, root).select("probe", "i", "j", "k", voxel_key().alias("vid"), (-F.col("agfe")).alias("f"))
    _, peaks = watershed.persistence(cut(score), ["probe"])
    return peaks.select("probe", "i", "j", "k", rounded("pf", 6).alias("height"), rounded("key", 6).alias("saddle"),
                        rounded("persistence", 6).alias("persistence"))


@query("h_maxima", ["hmax"], "SELECT probe, i, j, k FROM hmax")
def h_maxima(spark, root):
    score = fx.favourable(spark, root).select("probe", "i", "j", "k", voxel_key().alias("vid"), (-F.col("agfe")).alias("f"))
    return watershed.marker_voxels(cut(score), ["probe"], 0.5).select("probe", "i", "j", "k")


_SCORE = _flooded("wscore", "hmax", "SELECT probe, vid, agfe AS g FROM fav", ["hmax"])
_DISTANCE = _flooded("wdist", "apart", "SELECT probe, vid, -dist AS g FROM dmap", ["dmap", "apart"])


@query("watershed_hotspots", ["wscore_done"], _SCORE)
def watershed_hotspots(spark, root):
    lab = fx.favourable(spark, root).select("probe", "i", "j", "k", "agfe")
    return watershed.label(lab, ["probe"], fx.MIN_VOXELS)


@query("watershed_distance", ["wdist_done"], _DISTANCE)
def watershed_distance(spark, root):
    lab = fx.favourable(spark, root).select("probe", "i", "j", "k", "agfe")
    return watershed.label(lab, ["probe"], fx.MIN_VOXELS, watershed_mode="distance")


@query("distance_map", ["dmap"], "SELECT probe, i, j, k, dist FROM dmap")
def distance_map(spark, root):
    return watershed.distance_map(fx.favourable(spark, root).select("probe", "i", "j", "k"), ["probe"])
