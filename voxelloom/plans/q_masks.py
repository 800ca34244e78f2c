"""Queries: mask algebra, morphology, accessible volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.lattice import in_window
from voxelloom.operators import components, density, stencil
from voxelloom.plans import fixture_maps as fx
from voxelloom.plans.registry import query, view
from voxelloom.sources import tables as t

IN = "BETWEEN 0 AND 19"
OFF = "(SELECT unnest(range(-{r}, {r} + 1))::INT AS {d})"


def _offsets(r: int, cond: str) -> str:
    return (f"(SELECT di, dj, dk FROM {OFF.format(r=r, d='di')}, {OFF.format(r=r, d='dj')}, "
            f"{OFF.format(r=r, d='dk')} WHERE {cond})")


CROSS = _offsets(1, "abs(di) + abs(dj) + abs(dk) <= 1")
BALL1 = _offsets(1, "di * di + dj * dj + dk * dk <= 1")

# Solvent of each probe: water and its own atoms of every fifth frame.  Protein: voxels at rest.
view("solvent", ["positions", "water"], """
SELECT DISTINCT probe, CAST(floor(x / 2.5e0) AS INT) AS i, CAST(floor(y / 2.5e0) AS INT) AS j,
  CAST(floor(z / 2.5e0) AS INT) AS k FROM (
  SELECT probe, x, y, z FROM water, (SELECT DISTINCT probe FROM positions) WHERE frame % 5 = 0
  UNION ALL SELECT probe, x, y, z FROM positions WHERE frame % 5 = 0)""")
view("pvox", ["protein"], """
SELECT DISTINCT CAST(floor(x / 2.5e0) AS INT) AS i, CAST(floor(y / 2.5e0) AS INT) AS j,
  CAST(floor(z / 2.5e0) AS INT) AS k FROM protein""")
view("accmask", ["solvent", "pvox"], f"""
SELECT DISTINCT s.probe, s.i + di AS i, s.j + dj AS j, s.k + dk AS k FROM solvent s, {CROSS} o
WHERE s.i + di {IN} AND s.j + dj {IN} AND s.k + dk {IN}
  AND NOT EXISTS (SELECT 1 FROM pvox p WHERE p.i = s.i + di AND p.j = s.j + dj AND p.k = s.k + dk)""")
view("accmerged", ["accmask"], """
SELECT i, j, k FROM accmask GROUP BY ALL HAVING count(*) >= 0.5 * (SELECT count(DISTINCT probe) FROM accmask)""")
view("dense", ["fav"], "SELECT DISTINCT probe, i, j, k FROM agfe WHERE agfe < 0 AND i < 20 AND j < 20 AND k < 20")


def solvent(spark, root):
    """Voxels of water and of a probe's own atoms, for each probe."""
    atoms = t.positions(spark, root)
    panel = sorted(r["probe"] for r in atoms.select("probe").distinct().collect())        # a row per probe
    w = density.position_voxels(density.stride(t.water(spark, root), 5), t.GRID)
    w = w.withColumn("probe", F.explode(F.array(*map(F.lit, panel)) if panel else F.array().cast("array<string>")))
    p = density.with_voxel(density.stride(atoms, 5), t.GRID).select("probe", "i", "j", "k").distinct()
    return stencil.union(w, p, ["probe"])


def protein_voxels(spark, root):
    return density.position_voxels(t.protein(spark, root), t.GRID)


def accessible(spark, root):
    return stencil.accessible(solvent(spark, root), protein_voxels(spark, root), ["probe"], t.GRID, t.WINDOW)


def accessible_to_most(spark, root):
    """Voxels in the masks of at least half of the probes."""
    masks = accessible(spark, root)
    votes = masks.groupBy("i", "j", "k").agg(F.count_distinct("probe").alias("votes"))
    size = masks.agg(F.count_distinct("probe").alias("panel"))
    return votes.join(F.broadcast(size), F.col("votes") >= 0.5 * F.col("panel")).select("i", "j", "k")


def favourable_below_zero(spark, root):
    return (fx.raw(spark, root).filter((F.col("agfe") < 0) & in_window(t.WINDOW))
            .select("probe", "i", "j", "k"))


@query("mask_dilate", ["fav"], f"""
SELECT DISTINCT probe, f.i + di AS i, f.j + dj AS j, f.k + dk AS k FROM fav f, {CROSS} o
WHERE f.i + di {IN} AND f.j + dj {IN} AND f.k + dk {IN}""")
def mask_dilate(spark, root):
    return stencil.dilate(fx.favourable(spark, root), ["probe"], window=t.WINDOW)


def _erode(src: str) -> str:
    return f"""SELECT probe, i, j, k FROM (SELECT m.probe, m.i, m.j, m.k, count(*) AS need, count(n.i) AS have
  FROM (SELECT DISTINCT probe, i, j, k FROM {src}) m, {BALL1} o LEFT JOIN (SELECT DISTINCT probe, i, j, k FROM {src}) n
    ON n.probe = m.probe AND n.i = m.i + di AND n.j = m.j + dj AND n.k = m.k + dk
  WHERE m.i + di {IN} AND m.j + dj {IN} AND m.k + dk {IN} GROUP BY ALL) WHERE need = have"""


def _dilate(src: str) -> str:
    return f"""SELECT DISTINCT probe, f.i + di AS i, f.j + dj AS j, f.k + dk AS k FROM {src} f, {BALL1} o
WHERE f.i + di {IN} AND f.j + dj {IN} AND f.k + dk {IN}"""


@query("mask_open_close", ["dense"], f"""
SELECT 'open' AS step, probe, i, j, k FROM ({_dilate("(" + _erode("dense") + ")")})
UNION ALL SELECT 'close', probe, i, j, k FROM ({_erode("(" + _dilate("dense") + ")")})""")
def mask_open_close(spark, root):
    mask = favourable_below_zero(spark, root)
    opened = stencil.opening(mask, ["probe"], 1, t.WINDOW).withColumn("step", F.lit("open"))
    closed = stencil.closing(mask, ["probe"], 1, t.WINDOW).withColumn("step", F.lit("close"))
    return opened.unionByName(closed)


@query("accessible_mask", ["accmask"], "SELECT probe, i, j, k FROM accmask")
def accessible_mask(spark, root):
    return accessible(spark, root)


@query("accessible_count", ["accmask", "pvox"], f"""
SELECT probe, count(*) AS n_seen, greatest(1, 8000 - (SELECT count(*) FROM pvox WHERE i {IN} AND j {IN} AND k {IN})) AS cap,
  least(count(*), greatest(1, 8000 - (SELECT count(*) FROM pvox WHERE i {IN} AND j {IN} AND k {IN}))) AS n_accessible
FROM accmask WHERE (i + 0.5e0) * 2.5e0 BETWEEN -1e-9 AND 50.000000001e0
  AND (j + 0.5e0) * 2.5e0 BETWEEN -1e-9 AND 50.000000001e0 AND (k + 0.5e0) * 2.5e0 BETWEEN -1e-9 AND 50.000000001e0 GROUP BY probe""")
def accessible_count(spark, root):
    box = density.mean_box(t.frames(spark, root).withColumns({c: F.lit(t.BOX) for c in ("lx", "ly", "lz")}))
    return stencil.accessible_count(accessible(spark, root), protein_voxels(spark, root), ["probe"], t.GRID, t.WINDOW, box)


@query("mask_union", ["fav"], """
SELECT i, j, k FROM fav WHERE probe = 'BEN' UNION SELECT i, j, k FROM fav WHERE probe = 'ACT'""")
def mask_union(spark, root):
    f = fx.favourable(spark, root)
    return stencil.union(f.filter("probe = 'BEN'"), f.filter("probe = 'ACT'"), [])


@query("mask_intersect", ["agfe"], """
SELECT i, j, k FROM agfe WHERE probe = 'BEN' AND agfe < 0 INTERSECT
SELECT i, j, k FROM agfe WHERE probe = 'ACT' AND agfe < 0""")
def mask_intersect(spark, root):
    f = fx.raw(spark, root).filter("agfe < 0")
    return stencil.intersect(f.filter("probe = 'BEN'"), f.filter("probe = 'ACT'"), [])


@query("mask_difference", ["agfe"], """
SELECT i, j, k FROM agfe WHERE probe = 'BEN' AND agfe < 0 EXCEPT
SELECT i, j, k FROM agfe WHERE probe = 'ACT' AND agfe < 0""")
def mask_difference(spark, root):
    f = fx.raw(spark, root).filter("agfe < 0")
    return stencil.difference(f.filter("probe = 'BEN'"), f.filter("probe = 'ACT'"), [])


@query("mask_remove_small", ["lab6"], "SELECT probe, i, j, k FROM lab6 WHERE n_voxels > 2")
def mask_remove_small(spark, root):
    return components.remove_small(fx.favourable(spark, root), ["probe"], 2)


view("empty", ["dense"], """
SELECT p.probe, a.i, b.j, c.k, (a.i * 1000 + b.j) * 1000 + c.k AS vid FROM (SELECT DISTINCT probe FROM dense) p,
  (SELECT unnest(range(20))::INT AS i) a, (SELECT unnest(range(20))::INT AS j) b,
  (SELECT unnest(range(20))::INT AS k) c
  ANTI JOIN dense d ON d.probe = p.probe AND d.i = a.i AND d.j = b.j AND d.k = c.k""")
@query("mask_fill_holes", ["dense", "empty"], """
SELECT probe, i, j, k FROM dense UNION ALL
SELECT probe, i, j, k FROM (SELECT e.probe, e.i, e.j, e.k,
  (SELECT count(*) FROM empty n WHERE n.probe = e.probe AND abs(n.i - e.i) + abs(n.j - e.j) + abs(n.k - e.k) = 1) AS free
  FROM empty e) WHERE free = 0""")
def mask_fill_holes(spark, root):
    return components.fill_holes(favourable_below_zero(spark, root), ["probe"], 1, t.WINDOW)
