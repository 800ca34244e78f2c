"""Session helpers: where long plans are cut, and order statistics that never need one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables and stream state.

    Taken from ``spark.checkpoint.dir`` of the session.  Only a local session without
    the setting gets a temporary folder; on a cluster that would sit on one machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="voxelloom-")
    return _local_dirs[sc.applicationId]


_kept_roots: set[str] = set()


def gone_with_the_session(spark: SparkSession, path: str) -> None:
    """Have the file system delete a folder of stage tables when the driver ends."""
    if path not in _kept_roots:
        _kept_roots.add(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut(df: DataFrame) -> DataFrame:
    """Write *df* out once as a table in the shared folder and go on from there.

    A lost executor then costs no long replay.  The table also starts a fresh plan: a
    checkpointed frame keeps the constraints of what made it, and in a loop of self-joins
    they double every round.  The tables go when the application ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/voxelloom/{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_with_the_session(spark, root)
    return spark.read.schema(df.schema).parquet(path)


def per_map(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Join *df* with a table of a row per map, run or probe, on keys that have few values.

    The short side is written first, so the planner knows its size: below its broadcast threshold
    the long side stays where it is instead of moving to a handful of keys, and beyond it
    the join is an ordinary one.
    """
    few = cut(few)
    return df.join(few, keys) if keys else df.join(F.broadcast(few), F.lit(True))        # without keys: one row


def running_total(df: DataFrame, group: list[str], order: list, weight=None,
                  name: str = "before") -> DataFrame:
    """Exclusive prefix sum of *weight* (1 per row by default) in each group, along *order*.

    A window per group would put a whole group into one task.  Rows are range-partitioned
    over group and order instead; each partition sums its own part of a group, and the
    parts before it are added from a table of one row per group and partition.
    *order* must be total, or rows that tie share the places in any order.
    """
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = (df.repartitionByRange(*[F.col(g) for g in group], *order_cols)
              .withColumns({"_p": F.spark_partition_id(), "_w": w}))
    inside = Window.partitionBy("_p", *group).orderBy(*order_cols)
    tagged = cut(ranged.withColumn(
        "_in", F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")))
    parts = tagged.groupBy(*group, "_p").agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_p").alias("_q"),
                         F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_skip"))
    on = F.col("_p") == F.col("_q")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (tagged.join(parts, on, "inner")
            .withColumn(name, F.col("_in") + F.col("_skip"))
            .drop("_p", "_q", "_w", "_in", "_skip", *[f"_g_{g}" for g in group]))


def ranked(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based position in each group, for groups of any size."""
    return (running_total(df, group, order, name="_b")
            .withColumn(name, (F.col("_b") + 1).cast("int")).drop("_b"))


def _decades(v):
    """A scale with the order of the values on which orders of magnitude are as wide as each other."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746.0))


#: Bins of a counting round, and rows of a group that are few enough to be put in order.
SELECT_BINS, SELECT_ROWS = 1024, 4096


def kth(df: DataFrame, group: list[str], value: str, want: DataFrame, weight: str | None = None) -> DataFrame:
    """``group, k, value, less``: the value at the 0-based place *k* of each group, and the weight of all below it.

    *want* has the group and ``k``, several places of a group as several rows.  Nothing is sorted: counting rounds
    narrow the range of values, each a combined sum per group and bin, until a place has SELECT_ROWS candidates
    or only equal ones.  Bins are even in the values and in their magnitudes by turns, and a round splits its
    range at least between its least and greatest value, so it ends on any doubles, infinities included.  Null and NaN values take no part; a place beyond its group is left out.
    *df* is read once a round, so it should be a written table.
    """
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_w") > 0))
    ends = rows.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    want = want.select(*group, F.col("k").cast("bigint").alias("k"))

    def meet(left, right):  # a row per place at most on the right, in a written table of known size
        return left.join(right, group) if group else left.join(F.broadcast(right), F.lit(True))

    state = cut(meet(want, ends).withColumns({"_at": F.col("k"), "_less": F.lit(0).cast("bigint")}))
    busy = (F.col("_n") > SELECT_ROWS) & (F.col("_lo") < F.col("_hi"))
    turn = 0
    while not state.where(busy).isEmpty():
        near = meet(rows, state.where(busy)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        here, low, high = (_decades(F.col(c)) if turn % 2 else F.col(c) / 2 for c in ("_v", "_lo", "_hi"))
        part = F.nanvl((here - low) / (high - low), F.lit(0.5))
        at = (F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), SELECT_BINS - 1)
              .otherwise(F.least(F.floor(part * SELECT_BINS).cast("int"), F.lit(SELECT_BINS - 1))))
        bins = near.groupBy(*group, "k", "_at", "_less", at.alias("_bin")).agg(
            F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = Window.partitionBy(*group, "k").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)   # at most SELECT_BINS rows
        bins = bins.withColumn("_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        bins = bins.where((F.col("_b") <= F.col("_at")) & (F.col("_at") < F.col("_b") + F.col("_sum")))
        bins = bins.withColumns({"_at": F.col("_at") - F.col("_b"), "_less": F.col("_less") + F.col("_b")})
        state = cut(state.where(~busy).unionByName(bins.select(*state.columns)))
        turn += 1
    left = meet(rows, state).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    left = left.groupBy(*group, "k", "_at", "_less", "_v").agg(F.sum("_w").alias("_w"))
    before = Window.partitionBy(*group, "k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)       # at most SELECT_ROWS rows
    left = left.withColumn("_b", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    return (left.where((F.col("_b") <= F.col("_at")) & (F.col("_at") < F.col("_b") + F.col("_w")))
            .select(*group, "k", F.col("_v").alias("value"), (F.col("_less") + F.col("_b")).alias("less")))


def quantile(df: DataFrame, group: list[str], value: str, q, weight: str | None = None,
             name: str = "quantile") -> DataFrame:
    """Exact linear-interpolation quantile per group from the two order statistics next to it.

    *weight* says how many equal values a row stands for; *q* may be a column per group.  Null and NaN values take no part.
    """
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    qcol = F.lit(float(q)) if isinstance(q, (int, float)) else q
    df = cut(df.where(ok))
    totals = df.groupBy(*group).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("bigint").alias("_t"))
    totals = cut(totals.where("_t > 0").withColumn("_pos", qcol * (F.col("_t") - 1)).withColumn("_k", F.floor("_pos").cast("bigint")))
    places = F.array_distinct(F.array("_k", F.least(F.col("_k") + 1, F.col("_t") - 1)))
    found = kth(df, group, value, totals.select(*group, F.explode(places).alias("k")), weight)
    found = found.join(totals, group) if group else found.join(F.broadcast(totals), F.lit(True))
    return (found.groupBy(*group).agg(F.min("value").alias("_v0"), F.max("value").alias("_v1"),
                                      F.max(F.col("_pos") - F.col("_k")).alias("_f"))
            .select(*group, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_f")).alias(name)))
