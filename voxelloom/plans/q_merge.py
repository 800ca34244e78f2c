"""Queries: merging replica maps, resampling, alignment, map catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions.export import rounded
from voxelloom.operators import density, energy, merge
from voxelloom.plans import fixture_maps as fx
from voxelloom.plans.q_masks import IN
from voxelloom.plans.registry import KT, query, view
from voxelloom.sources import maps, tables as t

BY = ["probe", "replica"]


def _replica_maps(spark, root):
    return fx.raw(spark, root, BY).select(*BY, "i", "j", "k", "agfe")


def _merged(method):
    def run(spark, root):
        out = merge.merge_stored(_replica_maps(spark, root), ["probe"], method)
        return out.select("probe", "i", "j", "k", rounded("agfe", 6).alias("agfe"), "n_maps")
    return run


for _m, _sql in (("mean", "avg(agfe)"), ("min", "min(agfe)"), ("max", "max(agfe)"),
                 ("sum", "sum(agfe)"), ("median", "median(agfe)")):
    query(f"merge_{_m}", ["ragfe"], f"""
SELECT probe, i, j, k, round({_sql}, 6) + 0e0 AS agfe, count(*) AS n_maps FROM ragfe GROUP BY ALL""")(_merged(_m))

# Window of each run, and what its voxels not stored read.
view("rmeta", ["ragfe", "rtot"], f"""
SELECT probe, replica, min(i) AS lo_i, CAST(max(i) - min(i) + 1 - replica % 2 AS INT) AS n_i, min(j) AS lo_j,
  CAST(max(j) - min(j) + 1 AS INT) AS n_j, min(k) AS lo_k, CAST(max(k) - min(k) + 1 - replica AS INT) AS n_k,
  -{KT} * ln(1e-10 / (any_value(n_atoms) / 8000e0)) AS background
FROM ragfe JOIN rtot USING (probe, replica) GROUP BY probe, replica""")


def _metas(spark, root):
    """Run windows; runs 1 and 2 are cut shorter so that coverage differs."""
    m = fx.raw(spark, root, BY)
    spans = [c for a in "ijk" for c in (F.min(a).alias(f"lo_{a}"),
                                        (F.max(a) - F.min(a) + 1).alias(f"n_{a}"))]
    metas = m.groupBy(*BY).agg(*spans, F.first("n_atoms").alias("n_atoms"))
    metas = (metas.withColumn("n_i", (F.col("n_i") - F.col("replica") % 2).cast("int"))
             .withColumn("n_k", (F.col("n_k") - F.col("replica")).cast("int")))
    return energy.background(metas, t.FRAMES, t.N_ACCESSIBLE).drop("n_atoms")


_INSIDE = ("i >= {m}.lo_i AND i < {m}.lo_i + {m}.n_i AND j >= {m}.lo_j AND j < {m}.lo_j + {m}.n_j "
           "AND k >= {m}.lo_k AND k < {m}.lo_k + {m}.n_k")
_COVERED = """
SELECT s.probe, s.i, s.j, s.k, m.replica, coalesce(g.agfe, m.background) AS agfe
FROM (SELECT DISTINCT probe, i, j, k FROM ragfe) s
JOIN (SELECT * FROM rmeta QUALIFY row_number() OVER (PARTITION BY probe ORDER BY {order}, replica) = 1) r
  ON r.probe = s.probe AND {rin}
LEFT JOIN rmeta m ON m.probe = s.probe AND {min}
LEFT JOIN ragfe g ON g.probe = s.probe AND g.replica = m.replica AND g.i = s.i AND g.j = s.j AND g.k = s.k"""


def _covered(order):
    return _COVERED.format(order=order, rin=_q("r"), min=_q("m"))


def _q(m):
    text = _INSIDE.format(m=m)
    for a in "ijk":
        text = text.replace(f"{a} >= {m}", f"s.{a} >= {m}").replace(f"AND {a} < {m}", f"AND s.{a} < {m}")
    return text


@query("merge_coverage", ["rmeta"], f"""
SELECT probe, i, j, k, round(avg(agfe), 6) + 0e0 AS agfe, count(replica) AS n_cover FROM ({_covered("0")})
GROUP BY probe, i, j, k HAVING count(replica) > 0""")
def merge_coverage(spark, root):
    out = merge.merge_covered(_replica_maps(spark, root), _metas(spark, root), ["probe"], "mean")
    return out.select("probe", "i", "j", "k", rounded("agfe", 6).alias("agfe"), "n_cover")


@query("merge_reference_window", ["rmeta"], f"""
SELECT probe, i, j, k, round(min(agfe), 6) + 0e0 AS agfe, count(replica) AS n_cover
FROM ({_covered("n_i * n_j * n_k")}) GROUP BY probe, i, j, k HAVING count(replica) > 0""")
def merge_reference_window(spark, root):
    out = merge.merge_covered(_replica_maps(spark, root), _metas(spark, root), ["probe"], "min",
                              reference="smallest")
    return out.select("probe", "i", "j", "k", rounded("agfe", 6).alias("agfe"), "n_cover")


@query("reference_choice", ["rmeta"], """
SELECT probe, 'largest' AS choice, replica FROM rmeta
QUALIFY row_number() OVER (PARTITION BY probe ORDER BY n_i * n_j * n_k DESC, replica) = 1
UNION ALL SELECT probe, 'smallest', replica FROM rmeta
QUALIFY row_number() OVER (PARTITION BY probe ORDER BY n_i * n_j * n_k, replica) = 1
UNION ALL SELECT probe, 'first', min(replica) FROM rmeta GROUP BY probe""")
def reference_choice(spark, root):
    metas = _metas(spark, root)
    out = None
    for choice in merge.REFERENCES:
        part = merge.reference_map(metas, ["probe"], choice).select("probe", F.lit(choice).alias("choice"), "replica")
        out = part if out is None else out.unionByName(part)
    return out


@query("merge_strict", ["ragfe"], """
SELECT probe, i, j, k, round(max(agfe), 6) + 0e0 AS agfe, count(*) AS n_maps FROM ragfe GROUP BY ALL""")
def merge_strict(spark, root):
    """The strict merge checks shape and place first."""
    one = _replica_maps(spark, root)
    metas = one.select("probe", "replica").distinct().select(
        "probe", "replica", *[F.lit(0.0).alias(f"o{c}") for c in "xyz"], F.lit(t.GRID).alias("delta"),
        *[F.lit(t.CELLS).alias(f"n_{a}") for a in "ijk"])
    merge.check_strict(metas, ["probe"], "max")
    out = merge.merge_stored(one, ["probe"], "max")
    return out.select("probe", "i", "j", "k", rounded("agfe", 6).alias("agfe"), "n_maps")


# Target voxel t sits at source index t + shift.
SHIFT = (0.25, -0.5, 0.75)
view("shown", ["agfe"], "SELECT probe, i, j, k, agfe FROM agfe WHERE agfe < 0 AND i < 20 AND j < 20 AND k < 20")
_W = {a: f"(1e0 - abs(t{a} + {s}e0 - {a}))" for a, s in zip("ijk", SHIFT)}


@query("resample_trilinear", ["shown"], f"""
SELECT probe, ti AS i, tj AS j, tk AS k, round(sum({_W['i']} * {_W['j']} * {_W['k']} * agfe), 6) + 0e0 AS agfe
FROM shown, (SELECT unnest(range(20))::INT AS ti), (SELECT unnest(range(20))::INT AS tj),
  (SELECT unnest(range(20))::INT AS tk)
WHERE {_W['i']} > 0 AND {_W['j']} > 0 AND {_W['k']} > 0 GROUP BY ALL""")
def resample_trilinear(spark, root):
    shown = energy.shown_map(fx.raw(spark, root)).filter("i < 20 AND j < 20 AND k < 20")
    out = merge.resample_trilinear(shown, ["probe"], SHIFT, t.WINDOW)
    return out.select("probe", "i", "j", "k", rounded("agfe", 6).alias("agfe"))


_N = {a: f"floor(t{a} * 0.8e0 + {s}e0 + 0.5e0) = {a}" for a, s in zip("ijk", SHIFT)}


@query("resample_nearest", ["shown"], f"""
SELECT DISTINCT probe, ti AS i, tj AS j, tk AS k FROM shown, (SELECT unnest(range(20))::INT AS ti),
  (SELECT unnest(range(20))::INT AS tj), (SELECT unnest(range(20))::INT AS tk)
WHERE {_N['i']} AND {_N['j']} AND {_N['k']}""")
def resample_nearest(spark, root):
    shown = energy.shown_map(fx.raw(spark, root)).filter("i < 20 AND j < 20 AND k < 20")
    return merge.resample_nearest(shown, ["probe"], SHIFT, t.WINDOW, scale=0.8)


@query("majority_mask", ["rmeta"], f"""
SELECT probe, i, j, k FROM (SELECT s.probe, s.i, s.j, s.k, count(DISTINCT s.replica) AS votes,
  (SELECT count(*) FROM rmeta m WHERE m.probe = s.probe AND {_q("m")}) AS cover
  FROM ragfe s GROUP BY s.probe, s.i, s.j, s.k) WHERE cover > 0 AND votes / cover >= 0.5e0""")
def majority_mask(spark, root):
    return merge.majority(_replica_maps(spark, root), _metas(spark, root), ["probe"]).select("probe", "i", "j", "k")


@query("grid_alignment", ["ragfe"], """
SELECT * FROM (WITH m AS (SELECT probe, replica, min(i) * 2.5e0 + replica * 0.125e0 AS ox, min(j) * 2.5e0 AS oy,
  min(k) * 2.5e0 + (CASE WHEN replica = 2 THEN 2.5e0 ELSE 0e0 END) AS oz FROM ragfe GROUP BY probe, replica)
SELECT a.probe, a.replica AS reference, b.replica, CASE
  WHEN abs(a.ox - b.ox) <= 0.25e0 AND abs(a.oy - b.oy) <= 0.25e0 AND abs(a.oz - b.oz) <= 0.25e0 THEN 'aligned'
  WHEN abs((a.ox - b.ox) / 2.5e0 - round((a.ox - b.ox) / 2.5e0)) <= 1e-3
   AND abs((a.oy - b.oy) / 2.5e0 - round((a.oy - b.oy) / 2.5e0)) <= 1e-3
   AND abs((a.oz - b.oz) / 2.5e0 - round((a.oz - b.oz) / 2.5e0)) <= 1e-3 THEN 'shifted'
  ELSE 'resample' END AS relation
FROM m a JOIN m b ON a.probe = b.probe AND a.replica = 0)""")
def grid_alignment(spark, root):
    gs = F.lit(t.GRID)
    metas = _replica_maps(spark, root).groupBy(*BY).agg(
        (F.min("i") * gs + F.col("replica") * F.lit(0.125)).alias("ox"), (F.min("j") * gs).alias("oy"),
        (F.min("k") * gs + F.when(F.col("replica") == 2, gs).otherwise(F.lit(0.0))).alias("oz"))
    metas = metas.withColumns({"delta": gs, **{f"n_{a}": F.lit(20) for a in "ijk"}})
    return merge.alignment(metas, ["probe"])


view("mapfiles", ["positions"], """
SELECT DISTINCT 'map_agfe_' || atype || '_' || probe || '.dx' AS file FROM positions
UNION SELECT DISTINCT 'map_agfe_raw_' || atype || '_' || probe || '.dx' FROM positions
UNION SELECT DISTINCT 'map_agfe_' || probe || '.dx' FROM positions""")


@query("map_catalog", ["mapfiles"], """
SELECT file, p.probe, CASE WHEN file = 'map_agfe_' || p.probe || '.dx' THEN 'total'
  ELSE regexp_extract(file, 'map_agfe_(.+)_' || p.probe || '[.]dx', 1) END AS atype
FROM mapfiles JOIN (SELECT DISTINCT probe FROM positions) p ON ends_with(file, '_' || p.probe || '.dx')
WHERE NOT contains(file, '_raw_')""")
def map_catalog(spark, root):
    p = t.positions(spark, root)
    names = lambda pre, cols: p.select(F.concat(F.lit(pre), F.concat_ws("_", *cols), F.lit(".dx")).alias("file"))
    files = (names("map_agfe_", ["atype", "probe"]).union(names("map_agfe_raw_", ["atype", "probe"]))
             .union(names("map_agfe_", ["probe"])).distinct())
    return maps.catalog(files)


@query("typed_map_choice", ["mapfiles"], """
SELECT p.probe, 'typed' AS kind, count(*) AS n_maps
FROM mapfiles JOIN (SELECT DISTINCT probe FROM positions) p ON ends_with(file, '_' || p.probe || '.dx')
WHERE NOT contains(file, '_raw_') AND file <> 'map_agfe_' || p.probe || '.dx' GROUP BY p.probe""")
def typed_map_choice(spark, root):
    """Typed maps are taken where there are any; the single map serves otherwise."""
    return maps.choose(map_catalog(spark, root)).groupBy("probe", "kind").agg(F.count(F.lit(1)).alias("n_maps"))


@query("mask_covered_count", ["rmeta"], f"""
SELECT probe, replica, count(*) AS n_voxels FROM ragfe s WHERE i {IN} AND j {IN} AND k {IN} GROUP BY ALL""")
def mask_covered_count(spark, root):
    inside = _replica_maps(spark, root).filter("i BETWEEN 0 AND 19 AND j BETWEEN 0 AND 19 AND k BETWEEN 0 AND 19")
    return inside.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_voxels"))
