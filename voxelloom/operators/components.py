"""Connected components of voxel masks.

Three steps, none of which gathers a component or a map in one place:

1. Space is cut into cubes of a fixed edge.  A cube holds at most ``edge**3`` voxels of a
   map, whatever the data, and is labelled on its own in one Arrow group.
2. Voxels at cube faces give edges between cube-local pieces.
3. The piece graph, far smaller than the mask, is contracted by alternating star steps
   until it stops changing; the result is mapped back onto the voxels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxelloom.lattice import (IJK, half_offsets, key_shift, neighbour_offsets, offsets_array,
                               shift_each, voxel_key)
from voxelloom.spark import cut, ranked

BLOCK = 32


def _piece_roots(keys: np.ndarray, shifts: list[int]) -> np.ndarray:
    """Smallest key of each piece, for sorted voxel keys of one cube."""
    n = len(keys)
    pairs = []
    for s in shifts:
        at = np.searchsorted(keys, keys + s)
        hit = (at < n) & (keys[np.minimum(at, n - 1)] == keys + s)
        pairs.append(np.stack([np.nonzero(hit)[0], at[hit]]))
    a, b = np.concatenate(pairs, axis=1) if pairs else (np.empty(0, int), np.empty(0, int))
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (before == root).all():
            break
    return keys[root]


def _pieces(mask: DataFrame, by: list[str], connectivity: int, block: int) -> DataFrame:
    shifts = [key_shift(*o) for o in half_offsets(connectivity)]
    keyed = mask.select(*by, *IJK, voxel_key().alias("vid"),
                        *[F.floor(F.col(a) / F.lit(block)).cast("int").alias(f"b{a}") for a in IJK])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        return pdf.assign(piece=_piece_roots(pdf["vid"].to_numpy(), shifts))[names]

    names = [*by, *IJK, "vid", "piece"]
    types = dict(mask.select(*by).dtypes) if by else {}
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + [f"{a} int" for a in IJK]
                       + ["vid bigint", "piece bigint"])
    return keyed.groupBy(*by, *[f"b{a}" for a in IJK]).applyInPandas(label, schema)


def _cross_edges(pieces: DataFrame, by: list[str], connectivity: int, block: int) -> DataFrame:
    """Edges between pieces of neighbouring cubes, from the voxels at cube faces only."""
    at_face = F.lit(False)
    for a in IJK:
        m = F.pmod(F.col(a), F.lit(block))
        at_face = at_face | (m == 0) | (m == block - 1)
    face = pieces.filter(at_face)
    home = [F.floor(F.col(a) / F.lit(block)).cast("int") for a in IJK]
    moved = face.select(*by, F.col("piece").alias("u"), *IJK,
                        *[h.alias(f"h{a}") for a, h in zip(IJK, home)])
    moved = shift_each(moved, half_offsets(connectivity))
    left = F.lit(False)
    for a, h in zip(IJK, home):
        left = left | (h != F.col(f"h{a}"))
    moved = moved.filter(left).select(*by, "u", voxel_key().alias("vid"))
    return (moved.join(face.select(*by, "vid", F.col("piece").alias("v")), [*by, "vid"])
            .filter(F.col("u") != F.col("v"))
            .select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def contract(edges: DataFrame, by: list[str]) -> DataFrame:
    """Component root of every node of an edge list (u > v): rows ``(by, node, root)``.

    Large-star links every larger neighbour to the smallest, small-star every smaller one;
    together they end in one star per component.  A hub only widens one aggregate, which
    combines per task, and the join back has one row per node on its small side.
    """
    def smallest(sym):
        return sym.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def both(e):
        return e.select(*by, "u", "v").unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    current = cut(edges)
    seen = state(current)
    while seen[0]:
        sym = both(current)
        large = (sym.join(smallest(sym), [*by, "u"]).filter(F.col("v") > F.col("u"))
                 .select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = smallest(large)
        small = (large.join(low, [*by, "u"])
                 .select(*by, F.explode(F.array(
                     F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                     F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select(*by, "e.u", "e.v").filter(F.col("u") != F.col("v")).distinct())
        current = cut(small)
        now = state(current)
        if now == seen:
            break
        seen = now
    return current.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))


def components(mask: DataFrame, by: list[str], connectivity: int = 26, block: int = BLOCK) -> DataFrame:
    """Add ``root``, the smallest voxel key of the component each voxel belongs to."""
    neighbour_offsets(connectivity)          # rejects other values
    pieces = cut(_pieces(mask, by, connectivity, block))
    links = contract(_cross_edges(pieces, by, connectivity, block), by)
    merged = pieces.join(links.withColumnRenamed("node", "piece"), [*by, "piece"], "left")
    return merged.select(*by, *IJK, "vid", F.coalesce("root", "piece").alias("root"))


def number(labelled: DataFrame, by: list[str], min_voxels: int = 1, keep_numbers: bool = True) -> DataFrame:
    """Number components 1..n per map in raster order and drop those below *min_voxels*.

    Numbers are given before the size filter and are not closed up after it.
    """
    sizes = labelled.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("n_voxels"))
    numbered = ranked(sizes, by, ["root"], name="label")
    return labelled.join(numbered.filter(F.col("n_voxels") >= F.lit(int(min_voxels))), [*by, "root"])


def label(mask: DataFrame, by: list[str], connectivity: int = 26, min_voxels: int = 1,
          block: int = BLOCK) -> DataFrame:
    """Labelled voxels ``(by, i, j, k, label, n_voxels)`` of the components that are large enough."""
    out = number(components(mask, by, connectivity, block), by, min_voxels)
    return out.drop("vid", "root")


def remove_small(mask: DataFrame, by: list[str], max_size: int, connectivity: int = 6) -> DataFrame:
    """Drop components of at most *max_size* voxels."""
    found = components(mask, by, connectivity)
    big = (found.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > F.lit(int(max_size))))
    return found.join(big, [*by, "root"], "left_semi").select(*by, *IJK)


def fill_holes(mask: DataFrame, by: list[str], max_size: int, window: dict,
               connectivity: int = 6) -> DataFrame:
    """Fill background components of at most *max_size* voxels.

    The background is not stored.  A component that small stays within *max_size* face steps
    of the mask, so only background voxels that near are made; one that would be cut off by
    that reach is larger than *max_size* there already.
    """
    from voxelloom.operators import stencil
    near = stencil.dilate(mask, by, iterations=int(max_size) + 1, window=window)
    empty = stencil.difference(near, mask, by)
    found = components(empty, by, connectivity)
    holes = (found.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") <= F.lit(int(max_size))))
    filled = found.join(holes, [*by, "root"], "left_semi").select(*by, *IJK)
    return mask.select(*by, *IJK).unionByName(filled)
