"""Arithmetic and spatial predicates of setting up a box: volumes, bounds, candidate points."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelloom.lattice import explode_ball
from voxelloom.operators import pairs

# Fixed values in A: mesh step, reach of an atom, margin of the mesh; edge and clash distances.
MESH_STEP, MESH_REACH, MESH_PAD = 0.3, 1.5, 3.5
EDGE_CUTOFF, PROTEIN_CUTOFF = 2.5, 3.5


def mesh_volume(atoms: DataFrame, by: list[str], step: float = MESH_STEP, reach: float = MESH_REACH,
                pad: float = MESH_PAD) -> DataFrame:
    """Volume of a molecule as mesh points near its atoms.

    The mesh starts a margin below the molecule.  Each atom names the mesh points in its
    reach; the distinct ones are counted, so nothing meets in pairs.
    """
    low = atoms.groupBy(*by).agg(*[(F.min(c) - F.lit(pad)).alias(f"_{c}") for c in "xyz"])
    placed = atoms.select(*by, "x", "y", "z").distinct().join(low, by)
    n = int(reach / step) + 1
    near = explode_ball(placed, n + 1, (reach / step + 3 ** 0.5) ** 2)
    sq = F.lit(0.0)
    for c, d in zip("xyz", ("di", "dj", "dk")):
        at = F.floor((F.col(c) - F.col(f"_{c}")) / F.lit(step)).cast("int") + F.col(d)
        near = near.withColumn(f"m{c}", at)
        gap = F.col(f"_{c}") + F.col(f"m{c}") * F.lit(step) - F.col(c)
        sq = sq + gap * gap
    points = near.filter(sq <= F.lit(reach * reach)).select(*by, "mx", "my", "mz").distinct()
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points")).withColumn(
        "volume_ang3", F.round(F.col("n_points") * F.lit(step ** 3), 2))


def fit_check(molecules: DataFrame, receptor: DataFrame, box_volume: float) -> DataFrame:
    """Whether the copies asked for stay within half of the volume the receptor leaves free."""
    free = F.lit(float(box_volume)) - F.coalesce("v", F.lit(0.0))
    return (molecules.join(F.broadcast(receptor), F.lit(True))
            .withColumns({"requested": F.round(F.col("volume_ang3") * F.col("copies"), 3),
                          "available": F.round(free / F.lit(2.0), 3)})
            .withColumn("fits", F.col("requested") <= F.col("available"))
            .drop("v", "copies", "volume_ang3", "n_points"))


def box(atoms: DataFrame, by: list[str], padding: float) -> DataFrame:
    """Cubic box about the middle of the atoms: their farthest reach twice, and the padding."""
    mid = atoms.groupBy(*by).agg(*[((F.min(c) + F.max(c)) / F.lit(2.0)).alias(f"c{c}") for c in "xyz"])
    far = F.sqrt(sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"))
    joined = atoms.join(mid, by) if by else atoms.join(F.broadcast(mid), F.lit(True))
    rows = joined.groupBy(*by, "cx", "cy", "cz").agg(F.max(far).alias("_r"))
    width = F.greatest(F.lit(2.0) * F.col("_r") + F.lit(float(padding)), F.lit(2.0 * padding))
    rows = rows.withColumn("width", width)
    half = F.col("width") / F.lit(2.0)
    return rows.select(*by, "width", *[(F.col(f"c{c}") - half).alias(f"lower_{c}") for c in "xyz"],
                       *[(F.col(f"c{c}") + half).alias(f"upper_{c}") for c in "xyz"])


def _within(lower, upper) -> Column:
    cond = F.lit(True)
    for c, lo, hi in zip("xyz", lower, upper):
        cond = cond & (F.col(c) >= F.lit(float(lo))) & (F.col(c) <= F.lit(float(hi)))
    return cond


def in_box(atoms: DataFrame, by: list[str], lower, upper) -> DataFrame:
    return atoms.groupBy(*by).agg(F.bool_and(_within(lower, upper)).alias("in_box"),
                                  F.count_if(_within(lower, upper)).alias("n_inside"))


def drop_edges(points: DataFrame, lower, upper, distance: float = EDGE_CUTOFF) -> DataFrame:
    """Points farther than *distance* from every face."""
    near = F.lit(False)
    for c, lo, hi in zip("xyz", lower, upper):
        near = (near | (F.abs(F.lit(float(lo)) - F.col(c)) <= F.lit(distance))
                | (F.abs(F.lit(float(hi)) - F.col(c)) <= F.lit(distance)))
    return points.filter(~near)


def drop_clashes(points: DataFrame, atoms: DataFrame, distance: float = PROTEIN_CUTOFF,
                 ident: str = "point_id") -> DataFrame:
    """Points with no atom within *distance* (an anti join on the points found near one)."""
    tagged = atoms.select("x", "y", "z").distinct().withColumn("_one", F.lit(1))
    hit = pairs.touching(points, tagged, [], ident, "_one", distance)
    return points.join(hit, ident, "left_anti")


def membrane_side(points: DataFrame, lipids: DataFrame, side: str) -> DataFrame:
    """Points below the lipids (``inside``), above them (``outside``) or all (``both``)."""
    if side not in ("inside", "outside", "both"):
        raise ValueError(f"side must be inside, outside or both, got {side!r}")
    if side == "both":
        return points
    edge = lipids.agg((F.min("z") if side == "inside" else F.max("z")).alias("z")).scalar()
    return points.filter(F.col("z") <= edge if side == "inside" else F.col("z") >= edge)


def _radical_inverse(n: Column, base: int) -> Column:
    """Digits of *n* in *base*, mirrored behind the point; all digits a BIGINT can have."""
    total, d = F.lit(0.0), 0
    while base ** d < 1 << 63:
        digit = F.call_function("div", n.cast("bigint"), F.lit(base ** d).cast("bigint")) % F.lit(base)
        total, d = total + digit / F.lit(float(base) ** (d + 1)), d + 1
    return total


def halton(ids: DataFrame, n: str, lower=(0.0, 0.0, 0.0), upper=(1.0, 1.0, 1.0)) -> DataFrame:
    """Halton points in bases 2, 3 and 5 for the given numbers, scaled to a box."""
    out = ids
    for name, base, lo, hi in zip("uvw", (2, 3, 5), lower, upper):
        out = out.withColumn(name, F.lit(float(lo)) + F.lit(float(hi - lo)) * _radical_inverse(F.col(n), base))
    return out


def candidates(spark, count: int, lower, upper) -> DataFrame:
    """*count* candidate points in a box, made where they are used."""
    return halton(spark.range(count).withColumnRenamed("id", "point_id"), "point_id", lower, upper) \
        .withColumnsRenamed({"u": "x", "v": "y", "w": "z"})


def atom_names(atoms: DataFrame, by: list[str], symbol: str, order: str) -> DataFrame:
    """Element symbol and a counter within the molecule (molecules are small)."""
    w = Window.partitionBy(*by, symbol).orderBy(order)
    return atoms.withColumn("atom_name", F.concat(F.col(symbol), F.row_number().over(w).cast("string")))


def near_pairs(left: DataFrame, right: DataFrame, by_left: str, by_right: str, r_max: float) -> DataFrame:
    """Pairs within *r_max* per group of the left and group of the right side, with the least distance."""
    both = pairs.neighbours(pairs.packs(left, [], [by_left], r_max), pairs.packs(right, [], [by_right], r_max), [], r_max)
    kinds = {by_left: dict(left.dtypes)[by_left], by_right: dict(right.dtypes)[by_right]}

    def add(batches):
        for i, j, n, sq in pairs.totals(batches, by_left, by_right, r_max):
            yield pa.RecordBatch.from_arrays([i, j, pa.array(n), pa.array(sq)], [by_left, by_right, "n", "sq"])

    keep = [f"l_{c}" for c in ("x", "y", "z", by_left)] + [f"r_{c}" for c in ("x", "y", "z", by_right)]
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n bigint, sq double"
    return (both.select(*keep, F.struct("l_pack.*").alias("same")).mapInArrow(add, schema).groupBy(by_left, by_right)
            .agg(F.sum("n").alias("n_pairs"), F.sqrt(F.min("sq")).alias("least")))
