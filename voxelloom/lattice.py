"""The global integer lattice every map lives on.

A voxel is ``(i, j, k) = floor(x / gridsize)`` per axis, whatever box or run it
came from, so maps of different runs meet by equality of indices.  The centre of
a voxel is ``(i + 0.5) * gridsize``.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

IJK = ("i", "j", "k")

# Three signed 21-bit indices packed in one BIGINT: sorts in raster order (k fastest).
_BIAS = 1 << 20
_MARGIN = 1 << 10
_J_SHIFT = 1 << 21
_I_SHIFT = 1 << 42


def voxel_index(coord, gridsize: float) -> Column:
    """Voxel index of a coordinate."""
    return F.floor(F.col(coord) / F.lit(float(gridsize))).cast("int") if isinstance(coord, str) \
        else F.floor(coord / F.lit(float(gridsize))).cast("int")


def with_voxel(df: DataFrame, gridsize: float) -> DataFrame:
    """Add ``i, j, k`` from ``x, y, z``."""
    return df.withColumns({a: voxel_index(c, gridsize) for a, c in zip(IJK, "xyz")})


def centre(index, gridsize: float) -> Column:
    """Coordinate of a voxel centre; fractional indices interpolate."""
    col = F.col(index) if isinstance(index, str) else index
    return (col + F.lit(0.5)) * F.lit(float(gridsize))


def voxel_key(i="i", j="j", k="k") -> Column:
    """One sortable BIGINT for a voxel; raster order equals numeric order.

    An index near the end of its 21 bits would run into the next axis, offsets included, and is an error.
    """
    def wide(c):
        at = (F.col(c) if isinstance(c, str) else c).cast("bigint")
        far = F.abs(at) >= F.lit(_BIAS - _MARGIN)
        return F.when(far, F.raise_error(F.format_string("voxel index %d is out of range", at)).cast("bigint")).otherwise(
            at + F.lit(_BIAS))
    return (wide(i) * F.lit(_I_SHIFT) + wide(j) * F.lit(_J_SHIFT) + wide(k)).cast("bigint")


def key_shift(di: int, dj: int, dk: int) -> int:
    """What an offset adds to :func:`voxel_key`."""
    return di * _I_SHIFT + dj * _J_SHIFT + dk


def neighbour_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Face (6) or face, edge and corner (26) neighbours; anything else is an error."""
    if connectivity not in (6, 26):
        raise ValueError(f"connectivity must be 6 or 26, got {connectivity!r}")
    cube = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
    return [o for o in cube if connectivity == 26 or sum(map(abs, o)) == 1]


def half_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each opposite pair, so each undirected edge comes once."""
    return [o for o in neighbour_offsets(connectivity) if o > (0, 0, 0)]


def ball_offsets(radius: float) -> list[tuple[int, int, int]]:
    """Integer offsets within *radius* voxels of the origin (itself included)."""
    r = int(math.floor(radius))
    rng = range(-r, r + 1)
    return [o for o in itertools.product(rng, repeat=3)
            if o[0] ** 2 + o[1] ** 2 + o[2] ** 2 <= radius * radius + 1e-9]


def offsets_array(offsets) -> Column:
    """A short offset list as a literal array of structs, ready to explode."""
    return F.array(*[F.struct(F.lit(int(a)).alias("di"), F.lit(int(b)).alias("dj"),
                              F.lit(int(c)).alias("dk")) for a, b, c in offsets])


def shift_each(df: DataFrame, offsets) -> DataFrame:
    """Each voxel row once per offset, at the shifted position."""
    out = df.withColumn("_o", F.explode(offsets_array(offsets)))
    return (out.withColumns({"i": (F.col("i") + F.col("_o.di")).cast("int"),
                             "j": (F.col("j") + F.col("_o.dj")).cast("int"),
                             "k": (F.col("k") + F.col("_o.dk")).cast("int")})
            .drop("_o"))


def explode_ball(df: DataFrame, reach: int, sq_radius: float | None = None,
                 names=("di", "dj", "dk")) -> DataFrame:
    """Add one row per integer offset with ``|o|^2 <= sq_radius`` inside ``[-reach, reach]``.

    The inner axes are narrowed by what the outer ones leave, so no offset is made
    only to be filtered out.
    """
    sq = float(reach * reach if sq_radius is None else sq_radius)
    a, b, c = names

    def span(left):
        w = F.floor(F.sqrt(F.greatest(left, F.lit(0.0)) + F.lit(1e-9))).cast("int")
        return F.sequence(-w, w)

    out = df.withColumn(a, F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    out = out.filter(F.col(a) * F.col(a) <= F.lit(sq))
    out = out.withColumn(b, F.explode(span(F.lit(sq) - F.col(a) * F.col(a))))
    return out.withColumn(c, F.explode(span(
        F.lit(sq) - F.col(a) * F.col(a) - F.col(b) * F.col(b))))


def in_window(window: dict) -> Column:
    """Voxel inside ``{"i": (lo, hi), ...}``, *hi* exclusive."""
    cond = F.lit(True)
    for axis in IJK:
        lo, hi = window[axis]
        cond = cond & (F.col(axis) >= F.lit(int(lo))) & (F.col(axis) < F.lit(int(hi)))
    return cond


def window_size(window: dict) -> int:
    return math.prod(window[a][1] - window[a][0] for a in IJK)
