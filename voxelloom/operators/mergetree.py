"""Merge tree of the peaks of a sparse field: at which pass each peak meets higher ground.

Every voxel climbs to a peak, and the passes between slopes make a graph of peaks.  The tree is built by
contraction in blocks of space whose edge doubles every round.  Inside a block peaks are joined along falling passes,
the lower one dying into the higher (of equal ones the later in raster order).  A death only counts while no pass that leaves
the block lies higher, for then nothing outside can have come first; what is undecided waits for the larger
block.  So the rounds grow with the logarithm of the lattice's width, whatever the shape of the field.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxelloom.lattice import IJK
from voxelloom.spark import cut

BLOCK = 32
#: Two thirds of 2^20: whatever power of two the blocks have, places around the origin lie inside one, not on its border.
OFFSET = (1 << 21) // 3
NEVER = float("-inf")


def _settle(nodes: np.ndarray, height: np.ndarray, out: np.ndarray, a: np.ndarray, b: np.ndarray,
            saddle: np.ndarray) -> list[tuple[int, int, float]]:
    """``(peak, parent, saddle)`` of the peaks of one block whose death is certain.

    *nodes* are sorted; *out* is the highest pass that leaves the block from each; *a*, *b* are positions in *nodes*.
    """
    top = list(range(len(nodes)))
    limit, dead = out.tolist(), []
    tall = height.tolist()

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for n in np.lexsort((b, a, -saddle)).tolist():
        x, y, w = find(int(a[n])), find(int(b[n])), float(saddle[n])
        if x == y:
            continue
        low, high = (x, y) if (tall[x], -x) < (tall[y], -y) else (y, x)
        if limit[low] <= w:
            dead.append((int(nodes[low]), int(nodes[high]), w))
            top[low] = high
            limit[high] = max(limit[high], limit[low])
        else:                           # low's fate lies outside, so what lies beyond this pass is unknown to high as well
            limit[high] = max(limit[high], w)
    return dead


def _round(live: DataFrame, passes: DataFrame, by: list[str], size: int) -> DataFrame:
    """Deaths that blocks of edge *size* can decide, ``by, peak, parent, saddle``."""
    block = [f"_b{a}" for a in IJK]
    home = live.select(*by, "peak", "pf", *[F.floor((F.col(a) + F.lit(OFFSET)) / F.lit(size)).alias(f"_b{a}") for a in IJK])
    ends = passes
    for end in "ab":
        ends = ends.join(home.select(*by, F.col("peak").alias(end), *[F.col(c).alias(f"{end}{c}") for c in block]), [*by, end])
    apart = F.lit(False)
    for c in block:
        apart = apart | (F.col(f"a{c}") != F.col(f"b{c}"))
    ends = cut(ends.withColumn("_apart", apart))
    leaving = ends.filter("_apart").select(*by, F.explode(F.array("a", "b")).alias("peak"), "saddle")
    leaving = leaving.groupBy(*by, "peak").agg(F.max("saddle").alias("_out"))
    inner = ends.filter("NOT _apart").select(*by, *[F.col(f"a{c}").alias(c) for c in block], "a", "b", "saddle")
    busy = inner.select(*by, F.explode(F.array("a", "b")).alias("peak")).distinct()
    rows = home.join(busy, [*by, "peak"]).join(leaving, [*by, "peak"], "left").select(
        *by, *block, F.col("peak").alias("a"), F.col("peak").alias("b"), F.col("pf").alias("saddle"),     # a loop: a peak itself
        F.coalesce("_out", F.lit(NEVER)).alias("_out"))
    rows = rows.unionByName(inner.withColumn("_out", F.lit(None).cast("double")))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        node, edge = pdf[pdf["a"] == pdf["b"]].sort_values("a"), pdf[pdf["a"] != pdf["b"]]
        names = node["a"].to_numpy()
        place = [np.searchsorted(names, edge[c].to_numpy()) for c in "ab"]
        dead = _settle(names, node["saddle"].to_numpy(), node["_out"].to_numpy(), *place, edge["saddle"].to_numpy())
        out = pd.DataFrame(dead, columns=["peak", "parent", "saddle"]).astype(
            {"peak": "int64", "parent": "int64", "saddle": "float64"})
        for c in by:
            out[c] = pdf[c].iloc[0] if len(pdf) else None
        return out[[*by, "peak", "parent", "saddle"]]

    types = dict(live.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + ["peak bigint", "parent bigint", "saddle double"])
    return cut(rows.groupBy(*by, *block).applyInPandas(settle, schema))


def _ends(dead: DataFrame, by: list[str]) -> DataFrame:
    """``by, peak, last``: where a chain of deaths ends, by doubling the step."""
    current = dead.select(*by, "peak", F.col("parent").alias("last"))
    while True:
        step = current.select(*by, F.col("peak").alias("last"), F.col("last").alias("_next"))
        moved = cut(current.join(step, [*by, "last"], "left").select(
            *by, "peak", F.coalesce("_next", "last").alias("last"), F.col("_next").isNotNull().alias("_moved")))
        current = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            return current


def merge_tree(peaks: DataFrame, passes: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """``by, peak, pf, parent, saddle`` of peaks ``(by, peak, i, j, k, pf)`` joined by passes ``(by, a, b, saddle)``.

    ``saddle`` is the highest pass at which the peak meets a higher one, ``parent`` a higher peak behind it; both are
    null for the highest of each connected part.
    """
    live, size, told = cut(peaks.select(*by, "peak", "pf", *IJK)), int(block), None
    whole, rest = live, cut(passes.select(*by, "a", "b", "saddle"))
    while rest.limit(1).count():
        dead = _round(live, rest, by, size)
        told = dead if told is None else told.unionByName(dead)
        last = _ends(dead, by)
        for end in "ab":
            to = last.select(*by, F.col("peak").alias(end), F.col("last").alias("_to"))
            rest = rest.join(to, [*by, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        rest = cut(rest.filter("a <> b").groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .agg(F.max("saddle").alias("saddle")))
        live = cut(live.join(dead.select(*by, "peak"), [*by, "peak"], "left_anti"))
        size *= 2
    if told is None:
        return whole.select(*by, "peak", "pf", F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("double").alias("saddle"))
    return whole.select(*by, "peak", "pf").join(cut(told), [*by, "peak"], "left")


def higher_ground(tree: DataFrame, by: list[str]) -> DataFrame:
    """The tree with ``key``, the highest pass to strictly higher ground; null where there is none.

    A peak that dies into one of the same height only gets as high as that one does: such chains are followed by doubling.
    """
    tree = cut(tree)
    parent = tree.select(*by, F.col("peak").alias("parent"), F.col("pf").alias("_up"))
    start = tree.join(parent, [*by, "parent"], "left").select(
        *by, "peak", F.when(F.col("_up") == F.col("pf"), F.col("parent")).otherwise(F.col("peak")).alias("to"),
        F.coalesce("saddle", F.lit(NEVER)).alias("key"))
    current = cut(start)
    while current.filter("to <> peak").limit(1).count():
        step = current.select(*by, F.col("peak").alias("to"), F.col("to").alias("_next"), F.col("key").alias("_key"))
        moved = cut(current.join(step, [*by, "to"]).select(
            *by, "peak", F.col("_next").alias("to"), F.least("key", "_key").alias("key"), (F.col("_next") != F.col("to")).alias("_moved")))
        current = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            break
    return tree.join(current.select(*by, "peak", F.when(F.col("key") > F.lit(NEVER), F.col("key")).alias("key")), [*by, "peak"])
