"""Trajectory-shaped views over the star-schema tables.

Each view is a projection of one table, so filters and column pruning reach its scan.
Orders, line items and parts stand in for solvent, probe atoms and protein atoms; all
coordinates come from integers or exact binary fractions, so any engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Geometry of the views: box edge, voxel edge, voxels per axis, frames.
BOX, GRID, CELLS, FRAMES = 50.0, 2.5, 20, 50
WINDOW = {"i": (0, CELLS), "j": (0, CELLS), "k": (0, CELLS)}
N_ACCESSIBLE = CELLS ** 3


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def positions(spark: SparkSession, root: str) -> DataFrame:
    """Probe atoms per frame; about two in seven sit in small pockets, the rest in bulk."""
    return probe_atoms(table(spark, root, "lineitem"))


def probe_atoms(lineitem: DataFrame) -> DataFrame:
    """The projection behind :func:`positions`, for batch and streaming input alike."""
    return (lineitem
            .selectExpr(
                "CASE l_returnflag WHEN 'A' THEN 'BEN' WHEN 'N' THEN 'ACT' ELSE 'IPA' END AS probe",
                "CASE l_linestatus WHEN 'F' THEN 'HBD' ELSE 'Car' END AS atype",
                "cast(l_orderkey % 50 as int) AS frame",
                "cast(l_suppkey % 3 as int) AS replica",
                "l_orderkey % 97 AS resid",
                "l_orderkey * 10 + l_linenumber AS atom_id",
                "l_quantity AS q",
                "cast(round(l_extendedprice * 100) as bigint) AS cents",
                "l_partkey * 7 + l_suppkey * 13 + l_orderkey AS h",
                """cast(CASE WHEN l_linenumber > 2 THEN -1
                     WHEN l_returnflag = 'A' THEN l_partkey % 3
                     WHEN l_returnflag = 'N' THEN 1 + 2 * (l_partkey % 2)
                     ELSE 2 END as int) AS pocket""")
            .selectExpr(
                "probe", "atype", "frame", "replica", "resid", "atom_id",
                "CASE WHEN pocket < 0 THEN q - 0.5e0 ELSE 10 + 10 * pocket + (q - 25.5e0) * 0.1e0 END AS x",
                """CASE WHEN pocket < 0 THEN (cents % 5000) / 100e0
                   ELSE 12 + 8 * pocket + ((cents % 500) - 250) / 100e0 END AS y""",
                """CASE WHEN pocket < 0 THEN (h % 500) / 10e0
                   ELSE 40 - 9 * pocket + ((h % 50) - 25) / 10e0 END AS z"""))


def water(spark: SparkSession, root: str) -> DataFrame:
    """Water oxygens, spread evenly."""
    return (table(spark, root, "orders")
            .selectExpr("o_orderkey", "o_custkey",
                        "cast(round(o_totalprice * 100) as bigint) AS cents")
            .selectExpr(
                "cast(o_orderkey % 50 as int) AS frame", "cast(o_custkey % 3 as int) AS replica",
                "o_orderkey AS atom_id",
                "((o_orderkey * 7 + o_custkey * 13) % 500) / 10e0 AS x",
                "(cents % 5000) / 100e0 AS y",
                "((o_orderkey * 31 + cents) % 500) / 10e0 AS z"))


_PROTEIN = [
    "10 + 10 * ({a} % 4) + (({a} * 7) % 13 - 6) * 0.75e0 AS x",
    "12 + 8 * ({a} % 4) + (({a} * 11) % 13 - 6) * 0.75e0 AS y",
    "40 - 9 * ({a} % 4) + (({a} * 17) % 13 - 6) * 0.75e0 AS z",
]


def protein(spark: SparkSession, root: str) -> DataFrame:
    """Protein heavy atoms at rest, in shells around the pockets; 60 residues, two chains."""
    return table(spark, root, "part").selectExpr(
        "p_partkey AS atom_id", "p_partkey % 60 AS resid",
        "cast(p_partkey % 60 as int) AS resindex",
        "upper(substring(p_type, 1, 3)) AS resname",
        "CASE WHEN p_partkey % 60 < 30 THEN 'A' ELSE 'B' END AS chain",
        "upper(substring(p_name, 1, 1)) AS name", "p_brand AS atom_type",
        *[e.format(a="p_partkey") for e in _PROTEIN])


def protein_motion(spark: SparkSession, root: str) -> DataFrame:
    """Protein atoms over frames: the resting place and a small shake per observation."""
    base = [e.format(a="l_partkey") for e in _PROTEIN]
    shake = "((l_orderkey * {m} + l_suppkey) % 9 - 4) * 0.125e0"
    return (table(spark, root, "lineitem")
            .selectExpr("l_partkey AS atom_id", "l_partkey % 60 AS resid",
                        "cast(l_orderkey % 50 as int) AS frame", *base,
                        *[shake.format(m=m) + f" AS s{c}" for m, c in ((3, "x"), (5, "y"), (7, "z"))])
            .selectExpr("atom_id", "resid", "frame", "x + sx AS x", "y + sy AS y", "z + sz AS z"))


def frames(spark: SparkSession, root: str) -> DataFrame:
    """Box per replica and frame."""
    return (table(spark, root, "orders")
            .selectExpr("cast(o_custkey % 3 as int) AS replica", "cast(o_orderkey % 50 as int) AS frame")
            .groupBy("replica", "frame").agg(F.count(F.lit(1)).alias("n"))
            .selectExpr("replica", "frame", "50e0 + (frame % 5 - 2) * 0.0625e0 AS lx",
                        "50e0 + (frame % 7 - 3) * 0.0625e0 AS ly", "50e0 AS lz"))


def presence(spark: SparkSession, root: str) -> DataFrame:
    """Which molecule was in which zone at which frame (days since the first of 2024)."""
    return presence_of(table(spark, root, "events"))


def presence_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_type AS zone", "cast(user_id % 3 as int) AS replica", "user_id AS mol",
        "cast(floor((unix_micros(cast(ts as timestamp)) div 1000000 - 1704067200) / 86400e0) as int)"
        " AS frame")


# The same views as DuckDB common table expressions, for the oracle queries.
ORACLE_VIEWS = {
    "positions": """positions AS (
  SELECT probe, atype, frame, replica, resid, atom_id,
    CASE WHEN pocket < 0 THEN q - 0.5e0 ELSE 10 + 10 * pocket + (q - 25.5e0) * 0.1e0 END AS x,
    CASE WHEN pocket < 0 THEN (cents % 5000) / 100e0
         ELSE 12 + 8 * pocket + ((cents % 500) - 250) / 100e0 END AS y,
    CASE WHEN pocket < 0 THEN (h % 500) / 10e0
         ELSE 40 - 9 * pocket + ((h % 50) - 25) / 10e0 END AS z
  FROM (SELECT
    CASE l_returnflag WHEN 'A' THEN 'BEN' WHEN 'N' THEN 'ACT' ELSE 'IPA' END AS probe,
    CASE l_linestatus WHEN 'F' THEN 'HBD' ELSE 'Car' END AS atype,
    CAST(l_orderkey % 50 AS INT) AS frame, CAST(l_suppkey % 3 AS INT) AS replica,
    l_orderkey % 97 AS resid, l_orderkey * 10 + l_linenumber AS atom_id, l_quantity AS q,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    l_partkey * 7 + l_suppkey * 13 + l_orderkey AS h,
    CAST(CASE WHEN l_linenumber > 2 THEN -1 WHEN l_returnflag = 'A' THEN l_partkey % 3
         WHEN l_returnflag = 'N' THEN 1 + 2 * (l_partkey % 2) ELSE 2 END AS INT) AS pocket
    FROM lineitem))""",
    "water": """water AS (
  SELECT CAST(o_orderkey % 50 AS INT) AS frame, CAST(o_custkey % 3 AS INT) AS replica,
    o_orderkey AS atom_id, ((o_orderkey * 7 + o_custkey * 13) % 500) / 10e0 AS x,
    (cents % 5000) / 100e0 AS y, ((o_orderkey * 31 + cents) % 500) / 10e0 AS z
  FROM (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders))""",
    "protein": """protein AS (
  SELECT p_partkey AS atom_id, p_partkey % 60 AS resid, CAST(p_partkey % 60 AS INT) AS resindex,
    upper(substring(p_type, 1, 3)) AS resname,
    CASE WHEN p_partkey % 60 < 30 THEN 'A' ELSE 'B' END AS chain,
    upper(substring(p_name, 1, 1)) AS name, p_brand AS atom_type,
    10 + 10 * (p_partkey % 4) + ((p_partkey * 7) % 13 - 6) * 0.75e0 AS x,
    12 + 8 * (p_partkey % 4) + ((p_partkey * 11) % 13 - 6) * 0.75e0 AS y,
    40 - 9 * (p_partkey % 4) + ((p_partkey * 17) % 13 - 6) * 0.75e0 AS z
  FROM part)""",
    "protein_motion": """protein_motion AS (
  SELECT l_partkey AS atom_id, l_partkey % 60 AS resid, CAST(l_orderkey % 50 AS INT) AS frame,
    10 + 10 * (l_partkey % 4) + ((l_partkey * 7) % 13 - 6) * 0.75e0
       + ((l_orderkey * 3 + l_suppkey) % 9 - 4) * 0.125e0 AS x,
    12 + 8 * (l_partkey % 4) + ((l_partkey * 11) % 13 - 6) * 0.75e0
       + ((l_orderkey * 5 + l_suppkey) % 9 - 4) * 0.125e0 AS y,
    40 - 9 * (l_partkey % 4) + ((l_partkey * 17) % 13 - 6) * 0.75e0
       + ((l_orderkey * 7 + l_suppkey) % 9 - 4) * 0.125e0 AS z
  FROM lineitem)""",
    "frames": """frames AS (
  SELECT DISTINCT CAST(o_custkey % 3 AS INT) AS replica, CAST(o_orderkey % 50 AS INT) AS frame,
    50e0 + (o_orderkey % 50 % 5 - 2) * 0.0625e0 AS lx,
    50e0 + (o_orderkey % 50 % 7 - 3) * 0.0625e0 AS ly, 50e0 AS lz
  FROM orders)""",
    "presence": """presence AS (
  SELECT event_type AS zone, CAST(user_id % 3 AS INT) AS replica, user_id AS mol,
    CAST(floor((epoch_us(ts) // 1000000 - 1704067200) / 86400e0) AS INT) AS frame
  FROM events)""",
}
