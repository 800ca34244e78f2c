"""Shape descriptors of labelled regions.

Moments, extents, intensities and the Euler number are plain aggregates.  The hull works
on the extreme voxels of each region only.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxelloom.lattice import IJK, offsets_array
from voxelloom.operators import components

POWERS = list(itertools.product(range(4), repeat=3))


def _power(c: Column, p: int) -> Column:
    out = F.lit(1.0)
    for _ in range(p):
        out = out * c
    return out


def boxes(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Voxel count, bounding box (upper end exclusive), extent and equal-volume diameter."""
    volume = F.lit(1).cast("bigint")
    for a in IJK:
        volume = volume * (F.max(a) - F.min(a) + F.lit(1))
    n = F.count(F.lit(1))
    return labelled.groupBy(*by).agg(
        n.alias("area"), *[F.min(a).alias(f"bbox_lo_{a}") for a in IJK],
        *[(F.max(a) + F.lit(1)).cast("int").alias(f"bbox_hi_{a}") for a in IJK],
        volume.alias("area_bbox"), (n / volume).alias("extent"),
        F.pow(F.lit(6.0) * n / F.lit(math.pi), F.lit(1.0 / 3.0)).alias("equivalent_diameter_area"))


def moments(labelled: DataFrame, by: list[str], weight: Column | None = None,
            powers=POWERS, prefix: str = "m") -> DataFrame:
    """Raw moments about the corner of the bounding box, as ``m_pqr``."""
    low = labelled.groupBy(*by).agg(*[F.min(a).alias(f"_l{a}") for a in IJK])
    local = labelled.join(low, by)
    return _sums(local, by, [F.col(a) - F.col(f"_l{a}") for a in IJK], weight, powers, prefix)


def _sums(df, by, axes, weight, powers, prefix):
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by).agg(*[
        F.sum(w * _power(axes[0], p) * _power(axes[1], q) * _power(axes[2], r)).alias(f"{prefix}_{p}{q}{r}")
        for p, q, r in powers])


def centroids(labelled: DataFrame, by: list[str], weight: Column | None = None,
              prefix: str = "centroid") -> DataFrame:
    """Centroid in lattice indices and relative to the bounding box."""
    w = F.lit(1.0) if weight is None else weight
    c = {a: F.try_divide(F.sum(w * F.col(a)), F.sum(w)) for a in IJK}
    return labelled.groupBy(*by).agg(
        *[c[a].alias(f"{prefix}_{a}") for a in IJK],
        *[(c[a] - F.min(a)).alias(f"{prefix}_local_{a}") for a in IJK])


def central_moments(labelled: DataFrame, by: list[str], weight: Column | None = None,
                    powers=POWERS, prefix: str = "mu") -> DataFrame:
    """Moments about the centroid."""
    mid = centroids(labelled, by, weight, "_c").select(*by, *[f"_c_{a}" for a in IJK])
    return _sums(labelled.join(mid, by), by, [F.col(a) - F.col(f"_c_{a}") for a in IJK],
                 weight, powers, prefix)


def normalised(central: DataFrame, by: list[str], powers=POWERS, prefix: str = "mu",
               out: str = "nu") -> DataFrame:
    """Scale-free moments; undefined (NULL) below second order."""
    cols = []
    for p, q, r in powers:
        order = p + q + r
        v = (F.lit(None).cast("double") if order < 2 else
             F.try_divide(F.col(f"{prefix}_{p}{q}{r}"), F.pow(F.col(f"{prefix}_000"), F.lit(order / 3.0 + 1.0))))
        cols.append(v.alias(f"{out}_{p}{q}{r}"))
    return central.select(*by, *cols)


def inertia(central: DataFrame, by: list[str]) -> DataFrame:
    """Inertia tensor per unit mass from central moments."""
    m0 = F.col("mu_000")
    second = {"i": F.col("mu_200"), "j": F.col("mu_020"), "k": F.col("mu_002")}
    diag = {a: (second["i"] + second["j"] + second["k"] - second[a]) / m0 for a in IJK}
    return central.select(
        *by, *[diag[a].alias(f"inertia_{a}{a}") for a in IJK],
        (-F.col("mu_110") / m0).alias("inertia_ij"), (-F.col("mu_101") / m0).alias("inertia_ik"),
        (-F.col("mu_011") / m0).alias("inertia_jk"))


def axes(tensor: DataFrame, by: list[str]) -> DataFrame:
    """Eigenvalues of the tensor, largest first, and the axis lengths of the like ellipsoid.

    A symmetric 3x3 matrix has its eigenvalues in closed form, so this stays an expression.
    """
    return axes_columns(tensor).select(*by, "eig_1", "eig_2", "eig_3", "axis_major_length", "axis_minor_length")


def axes_columns(tensor: DataFrame) -> DataFrame:
    """The same as further columns of a table with ``inertia_ii .. inertia_jk``."""
    a, b, c = (F.col(f"inertia_{x}{x}") for x in IJK)
    d, e, f = F.col("inertia_ij"), F.col("inertia_ik"), F.col("inertia_jk")
    q = (a + b + c) / F.lit(3.0)
    p1 = d * d + e * e + f * f
    p2 = (a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + F.lit(2.0) * p1
    p = F.sqrt(p2 / F.lit(6.0))
    det = ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, F.lit(2.0) * p * p * p)))
    phi = F.acos(r) / F.lit(3.0)
    tiny = F.col("_p") < F.lit(1e-14)
    step = tensor.withColumns({"_q": q, "_p": p, "_phi": F.coalesce(phi, F.lit(0.0))})
    top = F.when(tiny, F.col("_q")).otherwise(F.col("_q") + F.lit(2.0) * F.col("_p") * F.cos("_phi"))
    low = F.when(tiny, F.col("_q")).otherwise(
        F.col("_q") + F.lit(2.0) * F.col("_p") * F.cos(F.col("_phi") + F.lit(2.0 * math.pi / 3.0)))
    out = step.withColumns({"eig_1": top, "eig_2": F.lit(3.0) * F.col("_q") - top - low, "eig_3": low}).drop("_q", "_p", "_phi")

    def length(x):
        return F.sqrt(F.lit(10.0) * F.greatest(F.lit(0.0), x))

    return out.withColumns({
        "axis_major_length": length(F.col("eig_1") + F.col("eig_2") - F.col("eig_3")),
        "axis_minor_length": length(F.col("eig_2") + F.col("eig_3") - F.col("eig_1"))})


def intensity(labelled: DataFrame, by: list[str], value: Column) -> DataFrame:
    return labelled.groupBy(*by).agg(
        F.max(value).alias("intensity_max"), F.avg(value).alias("intensity_mean"),
        F.min(value).alias("intensity_min"), F.stddev_pop(value).alias("intensity_std"))


def euler(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Vertices - edges + faces - cubes of the region as closed cubes (26-connected)."""
    cells = labelled.withColumn("_o", F.explode(offsets_array(
        list(itertools.product((-1, 0, 1), repeat=3)))))
    cells = cells.select(*by, *[(F.col(a) * 2 + 1 + F.col(f"_o.d{a}")).alias(f"c{a}") for a in IJK]).distinct()
    dim = sum(F.pmod(F.col(f"c{a}"), F.lit(2)) for a in IJK)
    return cells.groupBy(*by).agg(
        F.sum(F.when(F.pmod(dim, F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))).alias("euler_number"))


def filled_area(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Voxels of the region and of its cavities (background that does not reach the box border).

    The background of each padded box goes through the same block-wise labelling as a mask.
    """
    box = labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[f(a).alias(f"_{n}{a}")
                                                                  for a in IJK for n, f in (("l", F.min), ("h", F.max))])
    rows = box
    for a in IJK:
        rows = rows.withColumn(a, F.explode(F.sequence(F.col(f"_l{a}") - 1, F.col(f"_h{a}") + 1)))
    empty = rows.select(*by, *IJK).join(labelled.select(*by, *IJK), [*by, *IJK], "left_anti")
    found = components.components(empty, by, 26)
    edge = F.lit(False)
    for a in IJK:
        edge = edge | (F.col(a) < F.col(f"_l{a}")) | (F.col(a) > F.col(f"_h{a}"))
    holes = (found.join(box, by).groupBy(*by, "root")
             .agg(F.bool_or(edge).alias("_open"), F.count(F.lit(1)).alias("_size"))
             .filter(~F.col("_open")).groupBy(*by).agg(F.sum("_size").alias("_holes")))
    return box.join(holes, by, "left").select(
        *by, (F.col("_n") + F.coalesce("_holes", F.lit(0))).alias("area_filled"))


def _extremes(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Voxels that end a row of the region along every axis; no other can be a hull corner."""
    out = labelled.select(*by, *IJK)
    for a in IJK:
        rest = [x for x in IJK if x != a]
        ends = out.groupBy(*by, *rest).agg(F.min(a).alias("_a"), F.max(a).alias("_b"))
        out = ends.select(*by, *rest, F.explode(F.array_distinct(F.array("_a", "_b"))).alias(a))
    return out.select(*by, *IJK)


def _hull_planes(points: np.ndarray) -> np.ndarray:
    """Outward planes ``n.x <= d`` of the convex hull of integer points; empty if flat.

    Points are added one by one; the facets a point sees give way to those joining the
    rim of the seen part to it.  Integer arithmetic keeps every side test exact.
    """
    pts = np.unique(points, axis=0).astype(np.int64)
    first = pts[0]
    far = pts[np.argmax(((pts - first) ** 2).sum(1))]
    cross = np.cross(pts - first, far - first)
    third = pts[np.argmax((cross.astype(float) ** 2).sum(1))]
    normal = np.cross(far - first, third - first)
    side = (pts - first) @ normal
    if not normal.any() or not side.any():
        return np.empty((0, 4), np.int64)
    fourth = pts[np.argmax(np.abs(side))]
    corners = np.array([first, far, third, fourth])
    inside = corners.sum(0)                       # four times an interior point
    faces = np.array([[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]])

    def planes(tri):
        a, b, c = corners[tri[:, 0]], corners[tri[:, 1]], corners[tri[:, 2]]
        n = np.cross(b - a, c - a)
        d = (n * a).sum(1)
        flip = (n @ inside) > 4 * d
        n[flip], d[flip] = -n[flip], -d[flip]
        return np.column_stack([n, d])

    held = planes(faces)
    for p in pts:
        seen = held[:, :3] @ p > held[:, 3]
        if not seen.any():
            continue
        edges = np.sort(np.concatenate([faces[seen][:, [0, 1]], faces[seen][:, [1, 2]],
                                        faces[seen][:, [0, 2]]]), axis=1)
        rim, count = np.unique(edges, axis=0, return_counts=True)
        rim = rim[count == 1]
        corners = np.vstack([corners, p])
        new = np.column_stack([rim, np.full(len(rim), len(corners) - 1)])
        faces = np.concatenate([faces[~seen], new])
        held = np.concatenate([held[~seen], planes(new)])
    return held[held[:, :3].any(axis=1)]


def _hull_columns(planes: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Per (i, j) column of the box, the k-range inside the hull; planes are for doubled points."""
    gi, gj = np.meshgrid(np.arange(lo[0], hi[0] + 1), np.arange(lo[1], hi[1] + 1), indexing="ij")
    low = np.full(gi.shape, float(lo[2]))
    high = np.full(gi.shape, float(hi[2]))
    for a, b, c, d in planes:
        room = d - 2.0 * (a * gi + b * gj)
        if c > 0:
            high = np.minimum(high, np.floor(room / (2.0 * c) + 1e-10))
        elif c < 0:
            low = np.maximum(low, np.ceil(room / (2.0 * c) - 1e-10))
        else:
            high = np.where(room < 0, -np.inf, high)
    some = high >= low
    return gi[some], gj[some], low[some], high[some]


def _widest(points: np.ndarray) -> float:
    """Largest distance between two of the points, block by block."""
    best = 0.0
    for s in range(0, len(points), 512):
        part = points[s:s + 512]
        best = max(best, float(((part[:, None, :] - points[None]) ** 2).sum(-1).max()))
    return math.sqrt(best)


def hulls(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Convex volume in voxels, solidity and largest diameter per region.

    The hull is taken over the six face centres of each voxel.  One Arrow group per region
    sees its extreme voxels only: at most a few per lattice row, never the whole region.
    A region too flat to hull gives NULLs.
    """
    ends = _extremes(labelled, by)
    sizes = labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("area"))
    types = dict(labelled.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", area_convex bigint, feret_diameter_max double"

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        vox = pdf[list(IJK)].to_numpy(np.int64)
        shift = np.concatenate([np.eye(3, dtype=np.int64), -np.eye(3, dtype=np.int64)])
        planes = _hull_planes((2 * vox[:, None, :] + shift[None]).reshape(-1, 3))
        head = {c: [pdf[c].iloc[0]] for c in by}
        if not len(planes):
            return pd.DataFrame({**head, "area_convex": [None], "feret_diameter_max": [None]})
        gi, gj, low, high = _hull_columns(planes, vox.min(0), vox.max(0))
        ends = np.unique(np.concatenate([np.column_stack([gi, gj, low]), np.column_stack([gi, gj, high])]), axis=0)
        rims = (ends[:, None, :] + 0.5 * shift[None]).reshape(-1, 3)
        return pd.DataFrame({**head, "area_convex": [int((high - low + 1).sum())],
                             "feret_diameter_max": [_widest(_corners(rims))]})

    made = ends.groupBy(*by).applyInPandas(hull, schema)
    return made.join(sizes, by).withColumn("solidity", F.col("area") / F.col("area_convex"))


def _corners(points: np.ndarray) -> np.ndarray:
    """Points that end a row along every axis; the widest pair is among them."""
    out = points
    for a in range(3):
        rest = [x for x in range(3) if x != a]
        order = np.lexsort((out[:, a], out[:, rest[1]], out[:, rest[0]]))
        out = out[order]
        new = np.any(out[1:, rest] != out[:-1, rest], axis=1)
        keep = np.concatenate([[True], new]) | np.concatenate([new, [True]])
        out = out[keep]
    return out
