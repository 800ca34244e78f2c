"""What the text operators share: stage tables, word splitting, hashed bitmaps and components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelloom.spark import shared_dir

#: A-Z to lower case and the controls 9-13 to blanks, byte by byte; UTF-8 continuation bytes stay.
FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of anything but blank and the controls 9-13, A-Z lower-cased."""
    return raw.translate(FOLD).split()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Work:
    """Stage tables of one run, in the folder all executors share.

    A written table cuts the lineage, so a lost executor costs the tasks of one stage.
    ``drop`` deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # nothing reads the shuffle files of a finished write again: let Spark remove them at its end
        was = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if was is None else self.spark.conf.set(_CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the shortest unsigned type of at most 32 bits that holds them."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


BITMAP_BITS = 1 << 24


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bit per hashed value of *column* (long), packed: at most BITMAP_BITS bits, 2 MB, at any input size.

    A set bit says "maybe", a clear one "surely not", so what it filters is checked afterwards.
    """
    at = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    got = (df.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
           .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    out = np.zeros(BITMAP_BITS, dtype=bool)
    for row in got:
        # buckets count from 1 and hold 32768 bits; bucket 0 has position 0 alone
        bits = np.unpackbits(np.frombuffer(bytes(row["bits"]), dtype=np.uint8), bitorder="little")
        start = (row["bucket"] - 1) * 32768 + 1 if row["bucket"] > 0 else 0
        there = np.flatnonzero(bits) + start
        out[there[there < BITMAP_BITS]] = True
    return np.packbits(out)


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits).view(bool)


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: root is the smallest node reachable.

    Alternating stars: large stars link all larger neighbours of a node to the smallest one,
    small stars all smaller ones, until no link changes.  Each round is one written table.
    """
    e = work.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), f"{name}0")
    last, mark = f"{name}0", None
    step = 0
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.*").where("u <> v").distinct())
        step += 1
        nxt = work.put(small, f"{name}{step}")
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        work.drop(last)
        e, last, mark = nxt, f"{name}{step}", now
    roots = nxt.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
