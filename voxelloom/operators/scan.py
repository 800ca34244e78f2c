"""Everything that one pass over the positions can say, and what a second one adds.

A position counts for several things at once: the box of its frame, the extent of its probe, the voxel it
fell into, the mean and spread of its atom.  Each row is tagged with the kinds it counts for, and a single aggregation
keeps one row per kind and key.  Partial sums are made where the rows are read, so what moves is bounded by frames,
atoms and voxels and not by positions.  The stages of an analysis then start from slices of that table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from voxelloom.lattice import IJK, voxel_index
from voxelloom.operators import kinetics, qc
from voxelloom.spark import gone_with_the_session, shared_dir

KEYS = ["kind", "sim", "probe", "tag", "id", "resid", *IJK]


def by_kind(df: DataFrame) -> DataFrame:
    """Write a tagged table with a folder per kind, so that a slice reads nothing else."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/voxelloom/{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    df.repartition("kind", F.pmod(F.hash(*[c for c in df.columns if c in KEYS]), F.lit(16))).write.partitionBy("kind").parquet(path)
    gone_with_the_session(spark, root)
    kinds = [c for c in df.schema if c.name != "kind"]
    schema = df.select(*[c.name for c in kinds], "kind").schema
    return spark.read.schema(schema).parquet(path)


def accumulate(positions: DataFrame, gridsize: float, stride: int) -> DataFrame:
    """One row per kind and key over positions with ``sim, frame, atom_id, name, resname, resid, role, x, y, z``.

    ==========  =======================  =====================================================
    kind        key                      meaning
    ==========  =======================  =====================================================
    ``frame``   sim, id                  a frame: spans, mean place, box edges if the rows have them
    ``run``     sim, probe               a probe in a run: spans
    ``start``   sim, probe, id, resid    a heavy probe atom: where it was in its first frame
    ``count``   sim, probe, tag, voxel   visits by atoms of a type (tag), null where an atom has none
    ``seen``    sim, probe, tag, voxel   voxels that water, probe or protein (tag) was seen in, every *stride*-th frame
    ``atom``    sim, tag, id, resid      a heavy protein atom with its name (tag): mean and variance per axis
    ==========  =======================  =====================================================
    """
    voxel = [voxel_index(c, gridsize) for c in "xyz"]
    none = [F.lit(None).cast("int")] * 3
    empty = F.lit(None).cast("string")
    atype = F.col("atype") if "atype" in positions.columns else empty
    edges = [F.col(f"l{c}") if f"l{c}" in positions.columns else F.lit(None).cast("double") for c in "xyz"]
    place = F.struct("x", "y", "z")

    def tag(kind, when, probe=empty, tag=empty, id=None, resid=None, at=none, where=True, first=False, box=False):
        number = lambda v: F.lit(None).cast("bigint") if v is None else F.col(v).cast("bigint")
        return F.when(when, F.struct(
            F.lit(kind).alias("kind"), probe.alias("probe"), tag.alias("tag"), number(id).alias("id"), number(resid).alias("resid"),
            *[c.alias(a) for c, a in zip(at, IJK)], (place if where else F.lit(None).cast("struct<x:double,y:double,z:double>")).alias("p"),
            (F.col("frame") if first else F.lit(None)).cast("bigint").alias("since"),
            *[(e if box else F.lit(None)).cast("double").alias(f"l{c}") for e, c in zip(edges, "xyz")]))

    is_probe, is_heavy = F.col("role") == "probe", ~F.col("name").startswith("H")
    strided = F.col("frame") % F.lit(int(stride)) == 0
    seen = F.when(is_probe & is_heavy, "probe").when((F.col("role") == "water") & (F.col("name") == "O"), "water").when(
        (F.col("role") == "protein") & is_heavy, "protein")
    tags = F.array_compact(F.array(
        tag("frame", F.lit(True), id="frame", box=True),
        tag("run", is_probe, F.col("resname")),
        tag("start", is_probe & is_heavy, F.col("resname"), id="atom_id", resid="resid", first=True),
        tag("count", is_probe, F.col("resname"), atype, at=voxel, where=False),
        tag("seen", strided & seen.isNotNull(), F.when(seen == "probe", F.col("resname")), seen, at=voxel, where=False),
        tag("atom", (F.col("role") == "protein") & is_heavy, tag=F.col("name"), id="atom_id", resid="resid")))
    rows = positions.select("sim", F.explode(tags).alias("t")).select("sim", "t.*")
    per_axis = [f(f"p.{c}").alias(f"{n}{c}") for c in "xyz"
                for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("var", F.var_pop))]
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), *per_axis, *[F.max(f"l{c}").alias(f"l{c}") for c in "xyz"],
        F.min(F.when(F.col("since").isNotNull(), F.struct("since", "p.x", "p.y", "p.z"))).alias("first"))


def kind(scanned: DataFrame, name: str) -> DataFrame:
    return scanned.filter(F.col("kind") == name)


def frames(scanned: DataFrame) -> DataFrame:
    """``sim, frame, lx .. cz``: box edges, or the span of all atoms where the rows carry none, and the mean place."""
    return kind(scanned, "frame").select("sim", F.col("id").alias("frame"),
                                         *[F.coalesce(f"l{c}", F.col(f"hi{c}") - F.col(f"lo{c}")).alias(f"l{c}") for c in "xyz"],
                                         *[F.col(f"mean{c}").alias(f"c{c}") for c in "xyz"])


def spans(scanned: DataFrame) -> DataFrame:
    """``sim, probe, lox .. hiz``."""
    return kind(scanned, "run").select("sim", "probe", *[f"{e}{c}" for c in "xyz" for e in ("lo", "hi")])


def counts(scanned: DataFrame) -> DataFrame:
    """``sim, probe, atype, i, j, k, n``."""
    return kind(scanned, "count").select("sim", "probe", F.col("tag").alias("atype"), *IJK, "n")


def seen(scanned: DataFrame, what: str) -> DataFrame:
    return kind(scanned, "seen").filter(F.col("tag") == what).select("sim", "probe", *IJK)


def fluctuation(scanned: DataFrame) -> DataFrame:
    """``sim, atom_id, resid, rmsf`` of the heavy protein atoms."""
    return kind(scanned, "atom").select("sim", F.col("id").alias("atom_id"), "resid",
                                        F.sqrt(F.col("varx") + F.col("vary") + F.col("varz")).alias("rmsf"))


def mean_places(scanned: DataFrame, name: str) -> DataFrame:
    """``sim, atom_id, x, y, z`` of the protein atoms with a name."""
    return kind(scanned, "atom").filter(F.col("tag") == name).select(
        "sim", F.col("id").alias("atom_id"), *[F.col(f"mean{c}").alias(c) for c in "xyz"])


def first_places(scanned: DataFrame, order: DataFrame) -> DataFrame:
    """``probe, resid, x, y, z`` of heavy probe atoms in the first frame of the first run that has the probe.

    *order* has a row ``sim, sim_no`` per run.
    """
    start = kind(scanned, "start").select("sim", "probe", "resid", "first.*").join(F.broadcast(order), "sim")
    least = start.groupBy("probe").agg(F.min(F.struct("sim_no", "since")).alias("least")).select("probe", "least.*")
    return start.join(F.broadcast(least), ["probe", "sim_no", "since"]).select("probe", "resid", "x", "y", "z")


def follow(positions: DataFrame, zones: DataFrame | None, reference: DataFrame | None, name: str = "CA", edge: float = 6.0) -> DataFrame:
    """The second pass: who was in which zone, and the sums that superpose each frame on a reference.

    Kind ``zone`` has ``sim, probe, frame, atom_id, zone_id``, kind ``fit`` a row per run and frame for
    ``qc.decompose``.  *zones* are ``probe, zone_id, x, y, z, radius``, *reference* is ``sim, atom_id, x, y, z``.  Rows meet both by
    left joins in one flow, so the positions are read once whatever is asked.
    """
    rows = positions.filter((F.col("role") == "probe") | ((F.col("role") == "protein") & (F.col("name") == name)))
    is_probe = F.col("role") == "probe"
    rows = rows.select("sim", "frame", "atom_id", F.when(is_probe, F.col("resname")).alias("probe"), "x", "y", "z")
    rows = kinetics.cells(rows, edge)
    if zones is None:
        rows = rows.withColumn("zone_id", F.lit(None).cast("string"))
    else:
        z = kinetics.reach(zones, edge, F.col("radius")).select(
            F.col("probe").alias("zp"), "zone_id", "radius", *[F.col(f"g{c}").alias(f"h{c}") for c in "xyz"],
            *[F.col(c).alias(f"z{c}") for c in "xyz"])
        gap = sum((F.col(c) - F.col(f"z{c}")) * (F.col(c) - F.col(f"z{c}")) for c in "xyz")
        on = (F.col("probe") == F.col("zp")) & (gap <= F.col("radius") * F.col("radius"))
        for c in "xyz":
            on = on & (F.col(f"g{c}") == F.col(f"h{c}"))
        rows = rows.join(z, on, "left")
    if reference is None:
        rows = rows.withColumns({f"q{c}": F.lit(None).cast("double") for c in "xyz"})
    else:
        ref = reference.select(F.col("sim").alias("rs"), F.col("atom_id").alias("ra"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
        rows = rows.join(ref, (F.col("sim") == F.col("rs")) & F.col("probe").isNull() & (F.col("atom_id") == F.col("ra")), "left")
    rows = rows.filter(F.col("zone_id").isNotNull() | F.col("qx").isNotNull())
    return (rows.groupBy(F.when(F.col("zone_id").isNull(), "fit").otherwise("zone").alias("kind"), "sim", "frame", "probe", "zone_id",
                         F.when(F.col("zone_id").isNotNull(), F.col("atom_id")).alias("atom_id"))
            .agg(*qc.fit_sums()))
