"""Marker-controlled watershed on sparse voxels, without gathering a component anywhere.

Markers are maxima that stand at least *h* above the passes around them.  Every voxel first
climbs to a peak; the passes between the peaks' slopes form a small graph, and the merge tree of
that graph (:mod:`voxelloom.operators.mergetree`) says how far each peak stands out.

Flooding joins each voxel to the marker it meets at the lowest level.  That is the minimum
spanning forest rooted at the markers, so it is grown the way such forests are grown in
parallel: each part without a marker takes its lowest edge out, parts that chose each other
merge, and the graph shrinks by at least half per round.  Ties go to the lower neighbour,
then to raster order.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelloom.lattice import IJK, half_offsets, key_shift, neighbour_offsets, voxel_key
from voxelloom.operators import components, mergetree, smoothing
from voxelloom.spark import cut, ranked

MODES = ("score", "distance")


def _shifts(offsets):
    return F.array(*[F.lit(key_shift(*o)) for o in offsets])


def _edges(points: DataFrame, by: list[str], connectivity: int, value: str) -> DataFrame:
    """Neighbour pairs ``(u, v)`` inside the mask with the values of both ends."""
    sent = points.select(*by, F.col("vid").alias("u"), F.col(value).alias("fu"),
                         F.explode(_shifts(half_offsets(connectivity))).alias("_s"))
    sent = sent.select(*by, "u", "fu", (F.col("u") + F.col("_s")).alias("v"))
    return sent.join(points.select(*by, F.col("vid").alias("v"), F.col(value).alias("fv")), [*by, "v"])


def jump(links: DataFrame, by: list[str]) -> DataFrame:
    """Follow ``node -> parent`` to the end of every chain by doubling the step each round."""
    current = cut(links.select(*by, "node", "parent"))
    while True:
        step = current.select(*by, F.col("node").alias("parent"), F.col("parent").alias("_next"))
        moved = cut(current.join(step, [*by, "parent"])
                    .select(*by, "node", F.col("_next").alias("parent"),
                            (F.col("_next") != F.col("parent")).alias("_moved")))
        current = moved.select(*by, "node", "parent")
        if not moved.filter("_moved").limit(1).count():
            return current


def climb(points: DataFrame, by: list[str], value: str = "f") -> DataFrame:
    """``(node, parent)``: the peak every voxel reaches by steepest ascent over 26 neighbours."""
    around = [(0, 0, 0)] + neighbour_offsets(26)
    sent = points.select(*by, F.explode(_shifts(around)).alias("_s"), "vid", value)
    best = (sent.select(*by, (F.col("vid") + F.col("_s")).alias("node"),
                        F.struct(F.col(value), (-F.col("vid")).alias("nv")).alias("_b"))
            .groupBy(*by, "node").agg(F.max("_b").alias("_b")))
    best = best.join(points.select(*by, F.col("vid").alias("node")), [*by, "node"], "left_semi")
    return jump(best.select(*by, "node", (-F.col("_b.nv")).alias("parent")), by)


def slopes(points: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The voxels ``(by, i, j, k, vid, f, peak)`` with their peak, and the passes ``(by, a, b, saddle)`` between peaks."""
    peaks_of = climb(points, by)
    placed = cut(points.join(peaks_of.select(*by, F.col("node").alias("vid"), F.col("parent").alias("peak")),
                             [*by, "vid"]))
    passes = _edges(placed, by, 26, "f")
    root = placed.select(*by, "vid", "peak")
    passes = (passes.join(root.select(*by, F.col("vid").alias("u"), F.col("peak").alias("pu")), [*by, "u"])
              .join(root.select(*by, F.col("vid").alias("v"), F.col("peak").alias("pv")), [*by, "v"])
              .filter(F.col("pu") != F.col("pv"))
              .groupBy(*by, F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b"))
              .agg(F.max(F.least("fu", "fv")).alias("saddle")))
    return placed, passes


def persistence(points: DataFrame, by: list[str], block: int = mergetree.BLOCK) -> tuple[DataFrame, DataFrame]:
    """The voxels with their peak, and ``by, peak, i, j, k, pf, key, persistence`` of every peak.

    *points* holds ``vid`` and ``f`` (zero outside the mask).  ``key`` is the highest pass to strictly higher ground; a peak
    without one stands over the background.
    """
    placed, passes = slopes(points, by)
    peaks = placed.filter(F.col("vid") == F.col("peak")).select(*by, "peak", *IJK, F.col("f").alias("pf"))
    tree = mergetree.higher_ground(mergetree.merge_tree(peaks, passes, by, block), by)
    out = tree.join(peaks.drop("pf"), [*by, "peak"])
    return placed, cut(out.select(*by, "peak", *IJK, "pf", "key", (F.col("pf") - F.coalesce("key", F.lit(0.0))).alias("persistence")))


def marker_voxels(points: DataFrame, by: list[str], h: float) -> DataFrame:
    """Voxels on maxima that rise at least *h* above the highest pass to higher ground.

    *points* holds ``vid`` and ``f`` (zero outside the mask).  The highest maximum of a map always counts.
    """
    placed, peaks = persistence(points, by)
    top = placed.groupBy(*by).agg(F.max("f").alias("_top"))
    heights = peaks.join(top, by) if by else peaks.join(F.broadcast(top), F.lit(True))
    # The step below the top is a hair more than h, so that rounding cannot hide it.
    floor = F.least(F.lit(0.0), F.col("_top") - F.lit(float(h)) - F.abs("_top") * F.lit(2e-15))
    stands = F.col("pf") - F.greatest(F.coalesce("key", floor), floor) >= F.lit(float(h))
    kept = heights.filter(stands).select(*by, "peak", "pf")
    return (placed.join(kept, [*by, "peak"]).filter(F.col("f") == F.col("pf"))
            .select(*by, *IJK, "vid"))


def flood(points: DataFrame, markers: DataFrame, by: list[str], level: str = "g") -> DataFrame:
    """``(vid, mark)``: the marker whose basin each voxel joins; voxels no marker reaches are left out.

    *points* holds ``vid`` and the height to flood, *markers* ``(vid, mark)``.
    """
    part = points.select(*by, "vid").join(markers.select(*by, "vid", "mark"), [*by, "vid"], "left")
    # The part of a marker is named by its mark (negative), any other voxel by itself.
    part = cut(part.select(*by, "vid", F.coalesce(-F.col("mark").cast("bigint"), F.col("vid")).alias("part")))
    raw = _edges(points, by, 6, level)
    edges = (raw.select(*by, "u", "v", F.struct(F.greatest("fu", "fv").alias("hi"), F.least("fu", "fv").alias("lo"),
                                                F.col("u").alias("eu"), F.col("v").alias("ev")).alias("w"))
             .join(part.select(*by, F.col("vid").alias("u"), F.col("part").alias("a")), [*by, "u"])
             .join(part.select(*by, F.col("vid").alias("v"), F.col("part").alias("b")), [*by, "v"]))

    def shrink(e):
        live = e.filter((F.col("a") != F.col("b")) & ((F.col("a") >= 0) | (F.col("b") >= 0)))
        return cut(live.groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .agg(F.min("w").alias("w")))

    edges = shrink(edges)
    while edges.limit(1).count():
        both = edges.select(*by, "a", "b", "w").unionByName(
            edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        picks = (both.filter(F.col("a") >= 0).groupBy(*by, "a")
                 .agg(F.min_by("b", "w").alias("parent")).withColumnRenamed("a", "node"))
        back = picks.select(*by, F.col("node").alias("parent"), F.col("parent").alias("_back"))
        links = picks.join(back, [*by, "parent"], "left").select(
            *by, "node", F.when((F.col("_back") == F.col("node")) & (F.col("node") < F.col("parent")),
                                F.col("node")).otherwise(F.col("parent")).alias("parent"))
        roots = picks.select(*by, F.col("parent").alias("node")).filter(F.col("node") < 0).distinct()
        ends = jump(links.unionByName(roots.select(*by, "node", F.col("node").alias("parent"))), by)

        def follow(df, column):
            to = ends.select(*by, F.col("node").alias(column), F.col("parent").alias("_to"))
            return (df.join(to, [*by, column], "left")
                    .withColumn(column, F.coalesce("_to", column)).drop("_to"))

        part = cut(follow(part, "part"))
        edges = shrink(follow(follow(edges, "a"), "b"))
    return part.filter(F.col("part") < 0).select(*by, "vid", (-F.col("part")).cast("int").alias("mark"))


def _envelope(at: np.ndarray, start: np.ndarray, size: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Lower envelope of the parabolas ``d[q] + (x - q)^2`` inside each run, at all its places.

    The place whose parabola is lowest never moves back along a run, so the middle of every stretch is settled first and halves
    the candidates of both sides: all runs advance together, a level a time, in about n log n steps.
    """
    best = np.empty(len(at))
    lo, hi = start.astype(np.int64), (start + size).astype(np.int64)          # places still open
    left, right = lo.copy(), hi - 1                                             # their candidates, both ends in
    while len(lo):
        mid = (lo + hi) // 2
        n = right - left + 1
        first = np.cumsum(n) - n
        flat = np.repeat(left - first, n) + np.arange(int(n.sum()))
        gap = np.repeat(at[mid], n) - at[flat]
        cost = d[flat] + gap * gap
        least = np.minimum.reduceat(cost, first)
        best[mid] = least
        won = np.minimum.reduceat(np.where(cost == np.repeat(least, n), flat, len(at)), first)
        lo, hi, left, right = (np.concatenate(x) for x in ((lo, mid + 1), (mid, hi), (left, won), (won, right)))
        open_ = lo < hi
        lo, hi, left, right = lo[open_], hi[open_], left[open_], right[open_]
    return best


def _nearest(at: np.ndarray, first: np.ndarray, d: np.ndarray | None) -> np.ndarray:
    """Squared distances along one axis for unbroken runs; outside a run the distance is 0."""
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(at)))
    gap = np.minimum(at - np.repeat(at[start], size), np.repeat(at[start + size - 1], size) - at) + 1.0
    return gap * gap if d is None else np.minimum(gap * gap, _envelope(at, start, size, d))


def distance_map(mask: DataFrame, by: list[str]) -> DataFrame:
    """Exact distance of each mask voxel to the nearest voxel outside it, in voxels.

    One pass per axis over lattice lines.  A line's unbroken runs are dealt with whole, as Arrow columns; a run is at
    most as long as the lattice is wide, and a voxel moves as one row.
    """
    out = mask.select(*by, *IJK)
    for n, axis in enumerate(("k", "j", "i")):
        line = Window.partitionBy(*by, *[a for a in IJK if a != axis]).orderBy(axis)
        before = F.lag(axis).over(line)
        # sorted by line for the window, and mapped in that order
        marked = out.withColumn("_first", before.isNull() | (F.col(axis) - before > 1))
        names = [*by, *IJK, "_d"]

        def run(batches, axis=axis, later=n > 0, names=names):
            held = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = table if held is None else pa.concat_tables([held, table])
                starts = np.flatnonzero(table.column("_first").to_numpy())
                cut_at = int(starts[-1]) if len(starts) else 0          # the last run may go on in the next batch
                held = table.slice(cut_at)
                yield from solve(table.slice(0, cut_at), axis, later, names)
            if held is not None:
                yield from solve(held, axis, later, names)

        def solve(table, axis, later, names):
            if not table.num_rows:
                return
            d = _nearest(table.column(axis).to_numpy().astype(np.int64), table.column("_first").to_numpy(),
                         table.column("_d").to_numpy() if later else None)
            done = table.drop_columns(["_first", "_d"] if later else ["_first"]).append_column("_d", pa.array(d))
            yield from done.select(names).combine_chunks().to_batches()

        types = dict(mask.dtypes)
        out = marked.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in [*by, *IJK]] + ["_d double"]))
    return out.select(*by, *IJK, F.sqrt("_d").alias("dist"))


def spread_key() -> Column:
    """A number that looks random over neighbouring voxels and is the same every time."""
    return F.pmod(F.col("i").cast("bigint") * 73856093 + F.col("j").cast("bigint") * 19349663
                  + F.col("k").cast("bigint") * 83492791, F.lit((1 << 31) - 1))


def spaced_peaks(points: DataFrame, by: list[str], reach: int, value: str = "dist") -> DataFrame:
    """Largest values of their cube of half-edge *reach*; of equal ones too close, the one with the lower key stays.

    The kept ones are a maximal independent set by :func:`spread_key`: each round keeps every candidate whose key is the lowest
    around it.  Keys are spread, so long rows of equal values are done in a few rounds and not from end to end.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    best = points.select(*by, *IJK, F.col(value).alias("_m"))
    for axis in IJK:
        best = (best.withColumn("_s", F.explode(steps))
                .groupBy(*by, *[(F.col(a) + F.col("_s")).cast("int").alias(a) if a == axis else F.col(a)
                                for a in IJK]).agg(F.max("_m").alias("_m")))
    left = cut(points.join(best, [*by, *IJK]).filter(F.col(value) == F.col("_m"))
               .select(*by, *IJK, voxel_key().alias("vid"), spread_key().alias("_key")))
    kept = None
    cube = F.array(*[F.lit(key_shift(a, b, c)) for a in range(-reach, reach + 1)
                     for b in range(-reach, reach + 1) for c in range(-reach, reach + 1)])
    while left.limit(1).count():
        near = (left.select(*by, F.struct("_key", "vid").alias("_from"), F.explode(cube).alias("_s"))
                .select(*by, "_from", (F.col("_from.vid") + F.col("_s")).alias("vid")))
        first = near.groupBy(*by, "vid").agg(F.min("_from").alias("_first"))
        new = cut(left.join(first, [*by, "vid"]).filter(F.col("_first.vid") == F.col("vid")).drop("_first"))
        kept = new if kept is None else kept.unionByName(new)
        taken = (new.select(*by, F.col("vid").alias("_from"), F.explode(cube).alias("_s"))
                 .select(*by, (F.col("_from") + F.col("_s")).alias("vid")).distinct())
        left = cut(left.join(taken, [*by, "vid"], "left_anti"))
    return (kept if kept is not None else left).drop("_key")


def label(voxels: DataFrame, by: list[str], min_voxels: int = 1, h: float = 0.5,
          smoothing_sigma: float | None = None, min_distance: int | None = None,
          watershed_mode: str = "score") -> DataFrame:
    """Watershed clusters ``(by, i, j, k, label, n_voxels)`` of favourable voxels with ``agfe``."""
    if watershed_mode not in MODES:
        raise ValueError(f"watershed_mode must be one of {MODES}, got {watershed_mode!r}")
    mask = cut(voxels.select(*by, *IJK, voxel_key().alias("vid"),
                             F.greatest(-F.col("agfe"), F.lit(0.0)).alias("score")))
    if watershed_mode == "score":
        if min_distance is not None:
            warnings.warn("min_distance is ignored in score mode; h sets how much is split",
                          RuntimeWarning, stacklevel=2)
        seeded = mask.withColumn("f", F.col("score"))
        if smoothing_sigma is not None:
            soft = smoothing.gaussian_counts(mask, by, smoothing_sigma, count="score")
            seeded = mask.join(soft.withColumnRenamed("smooth", "f"), [*by, *IJK])
        seeds = marker_voxels(seeded, by, h)
        points = mask.withColumn("g", -F.col("score"))
    else:
        dist = cut(distance_map(mask, by))
        seeds = spaced_peaks(dist, by, 3 if min_distance is None else int(min_distance))
        points = mask.join(dist, [*by, *IJK]).withColumn("g", -F.col("dist"))
    pieces = components.components(seeds, by, 6)
    numbered = ranked(pieces.select(*by, "root").distinct(), by, ["root"], name="mark")
    marks = cut(pieces.join(numbered, [*by, "root"]).select(*by, "vid", "mark"))
    joined = flood(points.select(*by, "vid", "g"), marks, by)
    sizes = (joined.groupBy(*by, "mark").agg(F.count(F.lit(1)).alias("n_voxels"))
             .filter(F.col("n_voxels") >= F.lit(int(min_voxels))))
    return (joined.join(sizes, [*by, "mark"]).join(mask.select(*by, *IJK, "vid"), [*by, "vid"])
            .select(*by, *IJK, F.col("mark").alias("label"), "n_voxels"))
