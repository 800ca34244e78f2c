"""Queries: contacts, residues, structure checks, builder arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelloom.functions import thermo
from voxelloom.functions.export import rounded
from voxelloom.operators import builder, contacts, qc
from voxelloom.plans import fixture_maps as fx
from voxelloom.plans.q_masks import IN
from voxelloom.plans.registry import query, view
from voxelloom.sources import tables as t

view("pocket", ["hot", "protein"], """
SELECT h.probe, h.label, p.resid, h.i, h.j, h.k, min(sqrt(((i + 0.5e0) * 2.5e0 - x) ** 2 + ((j + 0.5e0) * 2.5e0 - y) ** 2
  + ((k + 0.5e0) * 2.5e0 - z) ** 2)) AS d, any_value(n_voxels) AS n_voxels
FROM hot h JOIN protein p ON sqrt(((i + 0.5e0) * 2.5e0 - x) ** 2 + ((j + 0.5e0) * 2.5e0 - y) ** 2
  + ((k + 0.5e0) * 2.5e0 - z) ** 2) <= 4.5e0 GROUP BY h.probe, h.label, p.resid, h.i, h.j, h.k""")


@query("pocket_residues", ["pocket"], """
SELECT probe, label, resid, count(*) AS n_contact_voxels, round(min(d), 4) AS min_dist_ang,
  round(count(*) / any_value(n_voxels), 4) AS contact_fraction FROM pocket GROUP BY probe, label, resid""")
def pocket_residues(spark, root):
    out = contacts.pocket_residues(fx.labelled(spark, root), t.protein(spark, root), ["probe", "label"], t.GRID,
                                   residue=("resid",))
    return out.select("probe", "label", "resid", "n_contact_voxels", rounded("min_dist", 4).alias("min_dist_ang"),
                      rounded("contact_fraction", 4).alias("contact_fraction"))


view("touch", ["positions", "protein_motion"], """
SELECT DISTINCT p.probe, p.replica, p.frame, p.resid AS mol, m.resid FROM positions p JOIN protein_motion m ON p.frame = m.frame
  AND (p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) + (p.z - m.z) * (p.z - m.z) <= 4e0""")


def _contacts(spark, root):
    mols = t.positions(spark, root).select(
        F.concat_ws("|", "probe", F.col("replica"), F.col("resid")).alias("mol"), "frame", "x", "y", "z")
    found = contacts.contacts(mols, t.protein_motion(spark, root), ["frame"], cutoff=2.0)
    part = F.split("mol", "\\|")
    return found.select("frame", "resid", part[0].alias("probe"), part[1].cast("int").alias("replica"),
                        part[2].cast("bigint").alias("mol"))


@query("contacts", ["touch"], "SELECT probe, replica, frame, mol, resid FROM touch")
def contact_rows(spark, root):
    return _contacts(spark, root).select("probe", "replica", "frame", "mol", "resid")


@query("contact_events", ["touch"], """
SELECT probe, resid, count(*) AS n_contact_events, count(DISTINCT frame) AS n_contact_frames,
  count(DISTINCT mol) AS n_contact_mols, string_agg(DISTINCT frame, ',' ORDER BY frame) AS contact_frames
FROM touch GROUP BY ALL""")
def contact_events(spark, root):
    out = contacts.contact_summary(_contacts(spark, root), ["probe", "resid"])
    return out.withColumn("contact_frames", F.array_join("contact_frames", ","))


@query("fused_residues", ["protein"], """
WITH s AS (SELECT resid, count(*) AS n_atoms FROM protein GROUP BY resid),
m AS (SELECT n_atoms FROM s GROUP BY n_atoms ORDER BY count(*) DESC, n_atoms LIMIT 1)
SELECT resid, s.n_atoms FROM s, m WHERE s.n_atoms > m.n_atoms""".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")")
def fused_residues(spark, root):
    return contacts.fused_residues(t.protein(spark, root))


@query("residue_embeddings", ["protein"], """
SELECT r.resid, len(e.embedding)::INT AS n_dims, round(e.embedding[1]::DOUBLE, 6) + 0e0 AS first_value
FROM (SELECT DISTINCT resid FROM protein) r LEFT JOIN embeddings e ON e.vec_id = r.resid""")
def residue_embeddings(spark, root):
    vectors = t.table(spark, root, "embeddings").select(F.col("vec_id").alias("resid"), "embedding")
    out = contacts.attach(t.protein(spark, root).select("resid").distinct(), vectors)
    return out.select("resid", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_dims"),
                      rounded(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query("unmatched_embeddings", ["protein"], """
SELECT count(*) AS n_unmatched FROM embeddings WHERE vec_id NOT IN (SELECT resid FROM protein)""")
def unmatched_embeddings(spark, root):
    vectors = t.table(spark, root, "embeddings").select(F.col("vec_id").alias("resid"))
    return contacts.unmatched(t.protein(spark, root).select("resid").distinct(), vectors).agg(
        F.count(F.lit(1)).alias("n_unmatched"))


view("armsf", ["protein_motion"], """SELECT atom_id, resid, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rmsf
  FROM protein_motion GROUP BY ALL""")


@query("rmsf_atom", ["armsf"], "SELECT atom_id, resid, round(rmsf, 6) + 0e0 AS rmsf FROM armsf")
def rmsf_atom(spark, root):
    out = qc.rmsf(t.protein_motion(spark, root), ["atom_id", "resid"])
    return out.withColumn("rmsf", rounded("rmsf", 6))


@query("rmsf_residue", ["armsf"], "SELECT resid, round(avg(rmsf), 6) AS rmsf, count(*) AS n_atoms FROM armsf GROUP BY resid")
def rmsf_residue(spark, root):
    out = qc.rmsf_by_residue(qc.rmsf(t.protein_motion(spark, root), ["atom_id", "resid"]))
    return out.withColumn("rmsf", rounded("rmsf", 6))


@query("residue_rmsf_lookup", ["armsf", "pocket"], """
SELECT probe, label, resid, round(any_value(r.rmsf), 4) AS rmsf FROM pocket
LEFT JOIN (SELECT resid, avg(rmsf) AS rmsf FROM armsf GROUP BY resid) r USING (resid) GROUP BY probe, label, resid""")
def residue_rmsf_lookup(spark, root):
    """Fluctuations put on pocket residues; residues without one keep NULL."""
    lining = contacts.pocket_residues(fx.labelled(spark, root), t.protein(spark, root), ["probe", "label"], t.GRID,
                                      residue=("resid",)).select("probe", "label", "resid")
    values = qc.rmsf_by_residue(qc.rmsf(t.protein_motion(spark, root), ["atom_id", "resid"]))
    return contacts.attach(lining, values.drop("n_atoms")).withColumn("rmsf", rounded("rmsf", 4))


@query("average_structure", ["protein_motion"], """
SELECT atom_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM protein_motion GROUP BY atom_id""")
def average_structure(spark, root):
    out = qc.average_structure(t.protein_motion(spark, root))
    return out.select("atom_id", *[rounded(c, 6).alias(c) for c in "xyz"])


@query("rmsd_nofit", ["protein_motion"], """
SELECT frame, round(sqrt(avg((m.x - a.x) ** 2 + (m.y - a.y) ** 2 + (m.z - a.z) ** 2)), 6) AS rmsd FROM protein_motion m
JOIN (SELECT atom_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM protein_motion GROUP BY atom_id) a USING (atom_id) GROUP BY frame""")
def rmsd_nofit(spark, root):
    motion = t.protein_motion(spark, root)
    return qc.rmsd(motion, qc.average_structure(motion), ["frame"]).withColumn("rmsd", rounded("rmsd", 6))


@query("rmsd_fit")
def rmsd_fit(spark, root):
    motion = t.protein_motion(spark, root)
    return qc.superposition(motion, qc.average_structure(motion), ["frame"]).select("frame", "n", "rmsd_fit")


@query("rmsd_after_fit")
def rmsd_after_fit(spark, root):
    """Deviation of all atoms after a fit on the even ones."""
    motion = t.protein_motion(spark, root)
    ref = qc.average_structure(motion)
    fit = qc.superposition(motion.filter("atom_id % 2 = 0"), ref, ["frame"])
    return qc.rmsd(qc.superpose(motion, fit, ["frame"]), ref, ["frame"])


# Distance pairs of one atom type per frame and run, over the periodic box.
_MI = "(({a}.{c} - {b}.{c}) - 50e0 * round(({a}.{c} - {b}.{c}) / 50e0))"
_SQ = " + ".join(f"{_MI.format(a='a', b='b', c=c)} ** 2" for c in "xyz")


def _rdf_sql(src_a: str, src_b: str, same: bool) -> str:
    p = "a.uid <> b.uid" if same else "true"
    minus = "- na" if same else ""
    return f"""
SELECT CAST(bin AS INT) AS bin, round((bin + 0.5e0) * 0.5e0, 6) AS r, n,
  round(n / (4e0 / 3e0 * pi() * (((bin + 1) * 0.5e0) ** 3 - (bin * 0.5e0) ** 3) * possible / 125000e0), 6) AS g FROM (
  SELECT g.bin, coalesce(n, 0) AS n, (SELECT sum(na * nb {minus}) FROM (SELECT replica, frame, count(*) AS na FROM {src_a} GROUP BY ALL)
     JOIN (SELECT replica, frame, count(*) AS nb FROM {src_b} GROUP BY ALL) USING (replica, frame)) AS possible
  FROM (SELECT unnest(range(30)) AS bin) g LEFT JOIN (
    SELECT least(29, CAST(floor(d / 0.5e0) AS BIGINT)) AS bin, count(*) AS n FROM (SELECT sqrt({_SQ}) AS d FROM {src_a} a JOIN {src_b} b
      ON a.replica = b.replica AND a.frame = b.frame AND {p}) WHERE d <= 15 GROUP BY 1) h ON h.bin = g.bin)"""


view("rdfa", ["positions"], """SELECT replica, frame, atom_id * 1000 + row_number() OVER (PARTITION BY atom_id ORDER BY x, y, z) AS uid,
  x, y, z FROM positions WHERE probe = 'BEN' AND atype = 'Car'""")
view("rdfw", ["water"], "SELECT replica, frame, atom_id AS uid, x, y, z FROM water")


def _rdf_atoms(spark, root):
    from pyspark.sql import Window
    w = Window.partitionBy("atom_id").orderBy("x", "y", "z")
    return (t.positions(spark, root).filter("probe = 'BEN' AND atype = 'Car'")
            .withColumn("uid", F.col("atom_id") * 1000 + F.row_number().over(w)))


def _g(out):
    return out.select("bin", rounded("r", 6).alias("r"), "n", rounded("g", 6).alias("g"))


@query("rdf", ["rdfa"], _rdf_sql("rdfa", "rdfa", True))
def rdf(spark, root):
    atoms = _rdf_atoms(spark, root)
    return _g(qc.rdf(atoms, atoms, ["replica", "frame"], "uid", 15.0, 30, box=t.BOX))


@query("rdf_water", ["rdfa", "rdfw"], _rdf_sql("rdfa", "rdfw", False))
def rdf_water(spark, root):
    waters = t.water(spark, root).withColumnRenamed("atom_id", "uid")
    atoms = _rdf_atoms(spark, root).withColumn("uid", -F.col("uid"))
    return _g(qc.rdf(atoms, waters, ["replica", "frame"], "uid", 15.0, 30, box=t.BOX, same=False))


@query("autocorrelation", ["positions"], """
WITH s AS (SELECT frame, n - avg(n) OVER () AS v FROM (SELECT frame, count(*) AS n FROM positions WHERE frame % 2 = 0 GROUP BY frame)),
o AS (SELECT row_number() OVER (ORDER BY frame) AS i, v FROM s),
c AS (SELECT b.i - a.i AS lag, sum(a.v * b.v) AS c FROM o a JOIN o b ON b.i >= a.i GROUP BY 1)
SELECT CAST(lag AS INT) AS lag, round(c, 4) + 0e0 AS autocorrelation, round(c / max(abs(c)) OVER (), 6) + 0e0 AS normalized FROM c
""".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")")
def autocorrelation(spark, root):
    series = t.positions(spark, root).groupBy("frame").agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = qc.autocorrelation(series, "frame", "n", every=2)
    return out.select("lag", rounded("autocorrelation", 4).alias("autocorrelation"),
                      rounded("normalized", 6).alias("normalized"))


@query("equilibration", [], """
SELECT CAST(o_orderkey % 50 AS INT) AS frame, round(avg(-o_totalprice), 4) AS energy, round(avg(300e0 + o_custkey % 7), 4) AS temperature,
  round(avg(125e0 + o_custkey % 3 * 0.25e0), 4) AS volume FROM orders GROUP BY ALL""")
def equilibration(spark, root):
    return (t.table(spark, root, "orders")
            .selectExpr("cast(o_orderkey % 50 as int) AS frame", "-o_totalprice AS e", "300e0 + o_custkey % 7 AS k",
                        "125e0 + o_custkey % 3 * 0.25e0 AS v")
            .groupBy("frame").agg(rounded(F.avg("e"), 4).alias("energy"), rounded(F.avg("k"), 4).alias("temperature"),
                                  rounded(F.avg("v"), 4).alias("volume")))


# Builder arithmetic.
@query("copies_from_concentration", ["protein"], """
SELECT resid, CAST(floor((0.05e0 + resid / 100e0) * (count(*) * 10e0 * 1e-24) * 6.02214076e23 + 0.5e0) AS BIGINT) AS copies
FROM protein GROUP BY resid""")
def copies_from_concentration(spark, root):
    return t.protein(spark, root).groupBy("resid").agg(F.count(F.lit(1)).alias("n")).select(
        "resid", thermo.copies_for(F.lit(0.05) + F.col("resid") / F.lit(100.0),
                                   thermo.nm3_to_litres(F.col("n") * F.lit(10.0))).alias("copies"))


view("meshpts", ["protein"], """
SELECT DISTINCT a.resid, i, j, k FROM (SELECT *, min(x) OVER w - 3.5e0 AS x0, min(y) OVER w - 3.5e0 AS y0, min(z) OVER w - 3.5e0 AS z0
  FROM protein WINDOW w AS (PARTITION BY resid)) a,
  (SELECT unnest(range(-6, 8)) AS di), (SELECT unnest(range(-6, 8)) AS dj), (SELECT unnest(range(-6, 8)) AS dk),
  LATERAL (SELECT CAST(floor((x - x0) / 0.3e0) AS INT) + di AS i, CAST(floor((y - y0) / 0.3e0) AS INT) + dj AS j,
    CAST(floor((z - z0) / 0.3e0) AS INT) + dk AS k)
WHERE (x0 + i * 0.3e0 - x) ** 2 + (y0 + j * 0.3e0 - y) ** 2 + (z0 + k * 0.3e0 - z) ** 2 <= 2.25e0""")


@query("mesh_volume", ["meshpts"], """
SELECT resid, count(*) AS n_points, round(count(*) * 0.027e0, 2) AS volume_ang3 FROM meshpts GROUP BY resid""")
def mesh_volume(spark, root):
    return builder.mesh_volume(t.protein(spark, root), ["resid"])


@query("box_bounds", ["protein"], """
SELECT chain, round(greatest(2 * r + 10, 20), 6) AS width, round(cx - greatest(2 * r + 10, 20) / 2, 6) + 0e0 AS lower_x,
  round(cy - greatest(2 * r + 10, 20) / 2, 6) + 0e0 AS lower_y, round(cz - greatest(2 * r + 10, 20) / 2, 6) + 0e0 AS lower_z,
  round(cx + greatest(2 * r + 10, 20) / 2, 6) AS upper_x, round(cy + greatest(2 * r + 10, 20) / 2, 6) AS upper_y,
  round(cz + greatest(2 * r + 10, 20) / 2, 6) AS upper_z FROM (
  SELECT p.chain, cx, cy, cz, max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS r FROM protein p JOIN (
    SELECT chain, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM protein GROUP BY chain) c
  ON c.chain = p.chain GROUP BY ALL)""")
def box_bounds(spark, root):
    out = builder.box(t.protein(spark, root), ["chain"], 10.0)
    return out.select("chain", *[rounded(c, 6).alias(c) for c in out.columns if c != "chain"])


@query("fit_check", ["protein", "meshpts"], """
SELECT resid, round(v * 40, 3) AS requested, round((125000e0 - total) / 2, 3) AS available, round(v * 40, 3) <= round((125000e0 - total) / 2, 3) AS fits
FROM (SELECT resid, round(count(*) * 0.027e0, 2) AS v FROM meshpts GROUP BY resid),
  (SELECT sum(v) AS total FROM (SELECT round(count(*) * 0.027e0, 2) AS v FROM meshpts GROUP BY resid))""")
def fit_check(spark, root):
    """Whether forty copies of each residue would fit in half of the free volume of the box."""
    vol = builder.mesh_volume(t.protein(spark, root), ["resid"])
    taken = vol.agg(F.sum("volume_ang3").alias("v"))
    return builder.fit_check(vol.withColumn("copies", F.lit(40)), taken, t.BOX ** 3)


@query("edge_prune", ["water"], """
SELECT atom_id FROM water WHERE NOT (abs(x) <= 2.5 OR abs(50 - x) <= 2.5 OR abs(y) <= 2.5 OR abs(50 - y) <= 2.5
  OR abs(z) <= 2.5 OR abs(50 - z) <= 2.5)""")
def edge_prune(spark, root):
    return builder.drop_edges(t.water(spark, root), (0.0,) * 3, (t.BOX,) * 3, 2.5).select("atom_id")


@query("clash_prune", ["water", "protein"], """
SELECT atom_id FROM water w WHERE NOT EXISTS (SELECT 1 FROM protein p
  WHERE (p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y) + (p.z - w.z) * (p.z - w.z) <= 12.25e0)""")
def clash_prune(spark, root):
    return builder.drop_clashes(t.water(spark, root), t.protein(spark, root), 3.5, "atom_id").select("atom_id")


@query("membrane_range", ["water", "protein"], f"""
SELECT 'inside' AS side, count(*) AS n_waters FROM water WHERE z <= (SELECT min(z) FROM protein WHERE chain = 'A')
UNION ALL SELECT 'outside', count(*) FROM water WHERE z >= (SELECT max(z) FROM protein WHERE chain = 'A')""")
def membrane_range(spark, root):
    lipids = t.protein(spark, root).filter("chain = 'A'")
    out = None
    for side in ("inside", "outside"):
        part = builder.membrane_side(t.water(spark, root), lipids, side).agg(F.count(F.lit(1)).alias("n_waters"))
        part = part.select(F.lit(side).alias("side"), "n_waters")
        out = part if out is None else out.unionByName(part)
    return out


@query("halton_points", [], """
SELECT o_orderkey AS n,
  round((SELECT sum(((o_orderkey // CAST(pow(2, d) AS BIGINT)) % 2) / pow(2, d + 1)) FROM (SELECT unnest(range(30)) AS d)), 9) AS u,
  round((SELECT sum(((o_orderkey // CAST(pow(3, d) AS BIGINT)) % 3) / pow(3, d + 1)) FROM (SELECT unnest(range(20)) AS d)), 9) AS v,
  round((SELECT sum(((o_orderkey // CAST(pow(5, d) AS BIGINT)) % 5) / pow(5, d + 1)) FROM (SELECT unnest(range(14)) AS d)), 9) AS w
FROM orders""")
def halton_points(spark, root):
    """The low-discrepancy candidate points numbered by the orders."""
    ids = t.table(spark, root, "orders").select(F.col("o_orderkey").alias("n"))
    return builder.halton(ids, "n").select("n", *[rounded(c, 9).alias(c) for c in ("u", "v", "w")])


@query("atom_names", ["protein"], """
SELECT resid, atom_id, element || CAST(row_number() OVER (PARTITION BY resid, element ORDER BY atom_id) AS VARCHAR) AS atom_name
FROM (SELECT resid, atom_id, substring(atom_type, 1, 1) AS element FROM protein)""")
def atom_names(spark, root):
    atoms = t.protein(spark, root).withColumn("symbol", F.substring("atom_type", 1, 1))
    return builder.atom_names(atoms, ["resid"], "symbol", "atom_id").select("resid", "atom_id", "atom_name")


@query("in_box", ["positions"], """
SELECT probe, frame, bool_and(x BETWEEN 0 AND 49 AND y BETWEEN 0 AND 49 AND z BETWEEN 0 AND 49) AS in_box,
  count(*) FILTER (x BETWEEN 0 AND 49 AND y BETWEEN 0 AND 49 AND z BETWEEN 0 AND 49) AS n_inside FROM positions GROUP BY ALL""")
def in_box(spark, root):
    return builder.in_box(t.positions(spark, root), ["probe", "frame"], (0.0,) * 3, (49.0,) * 3)


@query("near_pairs", ["water", "protein"], """
SELECT w.frame, p.resid, count(*) AS n_pairs, round(sqrt(min((p.x - w.x) ** 2 + (p.y - w.y) ** 2 + (p.z - w.z) ** 2)), 6) + 0e0 AS least
FROM water w JOIN protein p ON (p.x - w.x) ** 2 + (p.y - w.y) ** 2 + (p.z - w.z) ** 2 <= 9e0 GROUP BY w.frame, p.resid""")
def near_pairs(spark, root):
    """Water within three of each residue, in every frame."""
    out = builder.near_pairs(t.water(spark, root), t.protein(spark, root), "frame", "resid", 3.0)
    return out.withColumn("least", rounded("least", 6))
