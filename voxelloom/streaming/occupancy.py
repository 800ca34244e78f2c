"""Streaming counterparts: maps that grow with arriving frames, and stays as they happen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelloom.lattice import IJK
from voxelloom.operators import density, kinetics


def read_table(spark: SparkSession, root: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """One table of the folder, a file or a folder of part files, as a stream.

    A batch takes all files there are unless *files_per_trigger* says otherwise.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{root}/{name}[.]parquet")        # a pattern: a source path may not be a file itself


def histogram(positions: DataFrame, by: list[str], gridsize: float) -> DataFrame:
    """Running counts per voxel.  Counts only ever add, so late frames need no special care."""
    return density.histogram(positions, by, gridsize)


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Work off all there is, each micro-batch into its own folder.

    A batch that is tried again after a failure replaces its folder, so nothing doubles.
    """
    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    (stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def latest_counts(spark: SparkSession, out: str, by: list[str], count: str = "n") -> DataFrame:
    """The state of the counts from the update log: counts grow, so the largest is the last."""
    return spark.read.parquet(out).groupBy(*by, *IJK).agg(F.max(count).alias(count))


def windowed_counts(events: DataFrame, time: str, by: list[str], length: str, late: str,
                    slide: str | None = None) -> DataFrame:
    """Counts per event-time window; what comes later than *late* is dropped and state is freed."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return (events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n"))


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Stays as session windows: a silence longer than *gap* ends one.

    With frames a fixed time apart, the gap is the frame spacing times the absences bridged
    plus one, and a bit.
    """
    return (events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
            .select(*by, "first", "last", "n"))


def stays(presence: DataFrame, intermittency: int = 0, late: int | None = None) -> DataFrame:
    """Unbroken stays per zone, run and molecule from frames in any order.

    Without *late* the stays of a molecule stay in its state, a pair of frames each, so frames may come in
    any order.  With *late*, a watermark runs that many frames behind the newest frame of the whole stream:
    a stay that no frame ahead of it can touch leaves the state, and what arrives later is dropped and
    counted by Spark (``numRowsDroppedByWatermark`` of the query's progress).  Every change is
    emitted; see :func:`settled_stays` for the outcome.
    """
    reach = int(intermittency) + 1

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        starts, ends = (list(x) for x in state.get) if state.exists else ([], [])
        frames = sorted({int(f) for pdf in batches for f in pdf["frame"]})
        spans = sorted(list(zip(starts, ends)) + [(f, f) for f in frames])
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a - merged[-1][1] <= reach:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        live = merged
        if late is not None:
            closed = state.getCurrentWatermarkMs() // 1000 - 1 - reach
            live = [m for m in merged if m[1] >= closed]
        if live:
            state.update(([m[0] for m in live], [m[1] for m in live]))
            if late is not None:
                state.setTimeoutTimestamp(max((live[-1][1] + reach + 2) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        known = set(zip(starts, ends))
        changed = [m for m in merged if tuple(m) not in known]
        yield pd.DataFrame({"zone": key[0], "replica": key[1], "mol": key[2],
                            "start": pd.Series([m[0] for m in changed], dtype="int32"),
                            "end": pd.Series([m[1] for m in changed], dtype="int32")})

    kinds = dict(presence.dtypes)
    head = f"zone {kinds['zone']}, replica {kinds['replica']}, mol {kinds['mol']}"
    rows, timeout = presence.select("zone", "replica", "mol", "frame"), GroupStateTimeout.NoTimeout
    if late is not None:
        rows = rows.withColumn("at", F.timestamp_seconds(F.col("frame") + 1)).withWatermark("at", f"{int(late)} seconds")
        timeout = GroupStateTimeout.EventTimeTimeout
    return (rows.groupBy("zone", "replica", "mol")
            .applyInPandasWithState(update, f"{head}, start int, end int", "starts array<int>, ends array<int>",
                                    "update", timeout))


def settled_stays(log: DataFrame) -> DataFrame:
    """Stays of an update log without those a later, longer one took in.

    The window holds the stays of one molecule in one zone.
    """
    from pyspark.sql import Window
    longest = log.groupBy("zone", "replica", "mol", "start").agg(F.max("end").alias("end"))
    before = (Window.partitionBy("zone", "replica", "mol").orderBy("start")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (longest.withColumn("_e", F.max("end").over(before))
            .filter(F.col("_e").isNull() | (F.col("end") > F.col("_e"))).drop("_e"))


class _Closing(StatefulProcessor):
    """Open stays of a molecule in a zone; each leaves the state, once, when the watermark has passed all that could touch it."""

    def __init__(self, names: list[str], reach: int):
        self.names, self.reach = names, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start int, end int")

    def _settle(self, key, frames: list[int], now_ms: int) -> pd.DataFrame:
        spans = sorted([*((int(a), int(b)) for a, b in self.open.get()), *((f, f) for f in frames)])
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a - merged[-1][1] <= self.reach:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        live = [m for m in merged if self._closes(m[1]) > now_ms]
        if live:
            self.open.put([tuple(m) for m in live])
            self.handle.registerTimer(self._closes(live[0][1]))
        else:
            self.open.clear()
        done = [m for m in merged if self._closes(m[1]) <= now_ms]
        return pd.DataFrame({**{n: pd.Series([k] * len(done), dtype=object) for n, k in zip(self.names, key)},
                             "start": pd.Series([m[0] for m in done], dtype="int32"), "end": pd.Series([m[1] for m in done], dtype="int32")})

    def _closes(self, end: int) -> int:
        """When no frame that may still come can reach a stay: frame f has the time f + 1 seconds."""
        return (end + self.reach + 2) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = max(0, timerValues.getCurrentWatermarkInMs())
        frames = sorted({int(f) for pdf in rows for f in pdf["frame"] if (int(f) + 1) * 1000 > now})
        yield self._settle(key, frames, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def closed_stays(presence: DataFrame, late: int, intermittency: int = 0) -> DataFrame:
    """Stays ``zone, replica, mol, start, end``, each appended once when it is over.

    A watermark runs *late* frames behind the newest one.  The state of a molecule is its open stays alone; a timer takes out each
    that no frame ahead of the watermark can touch.  What comes later than the watermark is dropped.  Needs the state store
    :data:`STATE_STORE`.
    """
    kinds = dict(presence.dtypes)
    keys = ["zone", "replica", "mol"]
    rows = (presence.select(*keys, "frame").withColumn("at", F.timestamp_seconds(F.col("frame") + 1))
            .withWatermark("at", f"{int(late)} seconds"))
    return rows.groupBy(*keys).transformWithStateInPandas(
        _Closing(keys, int(intermittency) + 1), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start int, end int", "append", "eventTime")


def run_counts(stays: DataFrame, by: list[str], max_tau: int, out: str, checkpoint: str) -> None:
    """Work off a stream of closed stays into counts of starts, a folder a batch; a stay counts in one batch only.

    The counts of all batches add up (:func:`running_survival`), so no batch looks at an earlier one, and a batch that is
    tried again replaces its folder.
    """
    spark = stays.sparkSession
    was = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        def put(df: DataFrame, batch: int) -> None:
            kinetics.starts_of(df, by, max_tau).write.mode("overwrite").parquet(f"{out}/batch={batch}")

        (stays.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.unset(STATE_STORE[0]) if was is None else spark.conf.set(STATE_STORE[0], was)


def running_survival(counts: DataFrame, by: list[str], max_tau: int, last_frame, dt_ps: float = 1.0) -> DataFrame:
    """The survival curve of all stays counted so far; its size is that of frames and lags, not of molecules."""
    total = counts.groupBy(*by, "t", "left").agg(F.sum("c").alias("c"))
    return kinetics.survival_of(total, by, max_tau, last_frame, dt_ps)
