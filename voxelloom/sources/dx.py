"""OpenDX scalar maps as voxel tables.

Text lines carry no numbers, so a large file is read in splits and each line gets its
place from the lines before it in its split and the splits before that.  No task reads a
whole map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from voxelloom.lattice import IJK
from voxelloom.spark import running_total

def _numbered(spark: SparkSession, paths) -> DataFrame:
    """Lines as ``(map, line, value)``; a folder of part files is one map."""
    raw = (spark.read.format("text").load(paths)
           .select("value", F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("id"))
           .withColumn("map", F.regexp_replace("file", "/part-[^/]*$", "")))
    blocks = raw.groupBy("map", "file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("map").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return (raw.join(blocks, ["map", "file", "block"])
            .select("map", (F.col("id") - F.col("first") + F.col("skip")).alias("line"), "value"))


def read_header(lines: DataFrame) -> DataFrame:
    """Counts, origin (centre of the first voxel), spacing and first data line of each map."""
    words = F.split(F.trim("value"), "\\s+")
    counts = F.col("value").rlike("^object 1 class gridpositions counts")
    origin, delta = F.col("value").startswith("origin"), F.col("value").startswith("delta")
    pick = lambda cond, i, kind: F.max(F.when(cond, F.get(words, F.lit(i)).cast(kind)))
    head = lines.filter(counts | origin | delta | F.col("value").contains("data follows"))
    return head.groupBy("map").agg(
        *[pick(counts, 5 + n, "int").alias(f"n_{a}") for n, a in enumerate(IJK)],
        *[pick(origin, 1 + n, "double").alias(f"o{c}") for n, c in enumerate("xyz")],
        pick(delta, 1, "double").alias("delta"),
        F.max(F.when(F.col("value").contains("data follows"), F.col("line"))).alias("start"))


def read(spark: SparkSession, paths, keep_zero: bool = False) -> DataFrame:
    """``(map, i, j, k, value)`` on the global lattice; zeros are not stored unless asked for."""
    lines = _numbered(spark, paths)
    head = read_header(lines)
    data = lines.join(head, "map").filter((F.col("line") > F.col("start")) & F.col("value").rlike(r"^\s*[-+0-9.nN]"))
    data = data.withColumn("words", F.split(F.trim("value"), "\\s+"))
    # A line may hold any number of values: its first place is the sum of the lines before it.
    placed = running_total(data.withColumn("_n", F.size("words").cast("bigint")), ["map"], ["line"], weight="_n", name="base")
    whole = data.groupBy("map").agg(F.sum(F.size("words")).alias("_have"))
    want = F.col("n_i").cast("bigint") * F.col("n_j") * F.col("n_k")
    checked = head.join(whole, "map", "left").select("map", F.when(F.coalesce("_have", F.lit(0)) != want, F.raise_error(
        F.format_string("%s: %d values where the header says %d", "map", F.coalesce("_have", F.lit(0)), want))).alias("_bad"))
    placed = placed.join(checked, "map").filter(F.col("_bad").isNull())
    cells = placed.select("map", *[f"n_{a}" for a in IJK], *[f"o{c}" for c in "xyz"], "delta", "base",
                          F.posexplode("words").alias("at", "text"))
    at = F.col("base") + F.col("at")
    plane = F.col("n_j").cast("bigint") * F.col("n_k")
    local = {"i": F.floor(at / plane), "j": F.floor(F.pmod(at, plane) / F.col("n_k")),
             "k": F.pmod(at, F.col("n_k").cast("bigint"))}
    out = cells.filter(at < plane * F.col("n_i")).select(
        "map", *[(local[a] + F.round(F.col(f"o{c}") / F.col("delta") - F.lit(0.5))).cast("int").alias(a)
                 for a, c in zip(IJK, "xyz")], F.col("text").cast("double").alias("value"))
    return out if keep_zero else out.filter(F.col("value") != 0)


PER_LINE = 3


def frame_lines(window: dict, gridsize: float) -> tuple[list[str], list[str]]:
    """What stands before and after the values of a map."""
    size = [window[a][1] - window[a][0] for a in IJK]
    counts = " ".join(map(str, size))
    origin = " ".join(repr((window[a][0] + 0.5) * gridsize) for a in IJK)
    d = repr(float(gridsize))
    head = [f"object 1 class gridpositions counts {counts}", f"origin {origin}", f"delta {d} 0 0", f"delta 0 {d} 0",
            f"delta 0 0 {d}", f"object 2 class gridconnections counts {counts}",
            f"object 3 class array type double rank 0 items {size[0] * size[1] * size[2]} data follows"]
    foot = ['attribute "dep" string "positions"', 'object "map" class field', 'component "positions" value 1',
            'component "connections" value 2', 'component "data" value 3']
    return head, foot


def text_lines(voxels: DataFrame, window: dict, gridsize: float, value: str, background: float = 0.0) -> DataFrame:
    """The lines of one map in order, as ``(line, text)``."""
    spark = voxels.sparkSession
    size = [window[a][1] - window[a][0] for a in IJK]
    total = size[0] * size[1] * size[2]
    head, foot = frame_lines(window, gridsize)
    per_line = PER_LINE
    last = (total + per_line - 1) // per_line
    frame = ([(n - len(head), t) for n, t in enumerate(head)] + [(last + n, t) for n, t in enumerate(foot)])
    at = sum((F.col(a) - F.lit(window[a][0])).cast("bigint") * F.lit(m)
             for a, m in zip(IJK, (size[1] * size[2], size[2], 1)))
    inside = F.lit(True)
    for a in IJK:
        inside = inside & (F.col(a) >= F.lit(window[a][0])) & (F.col(a) < F.lit(window[a][1]))
    held = voxels.filter(inside).select(at.alias("id"), F.col(value).cast("double").alias("v"))
    body = (spark.range(total).join(held, "id", "left").select(
        F.floor(F.col("id") / F.lit(per_line)).alias("line"), "id", F.coalesce("v", F.lit(float(background))).alias("v"))
        .groupBy("line").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("c"))
        .select("line", F.array_join(F.transform("c", lambda e: e["v"].cast("string")), " ").alias("text")))
    return body.unionByName(spark.createDataFrame(frame, "line bigint, text string"))


def write(voxels: DataFrame, path: str, window: dict, gridsize: float, value: str, background: float = 0.0) -> None:
    """Write one map as a folder of part files whose names sort in file order.

    Lines are range-partitioned, so the tasks write their stretches side by side; the parts
    joined by name are one plain DX file.
    """
    lines = text_lines(voxels, window, gridsize, value, background)
    (lines.repartitionByRange("line").sortWithinPartitions("line").select("text")
     .write.mode("overwrite").text(path))
