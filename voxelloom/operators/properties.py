"""Region properties by name: exactly those asked for, from one aggregation over the voxels.

A property says which running aggregates it needs and how its value follows from them.  The aggregates of
all properties asked for are merged, so a shared one is computed once and the voxels are grouped once.  Users add
their own as aggregate columns.  Values are scalars, lists or slices; :func:`serialised` writes any of them as text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from voxelloom.lattice import IJK
from voxelloom.operators import regions

PREFIX = "geom_"


def _aggregates(value: str) -> dict[str, Column]:
    """The running aggregates there are, by name; second moments about the mean come from stable one-pass sums."""
    w = F.greatest(-F.col(value), F.lit(0.0))
    out = {"n": F.count(F.lit(1)), "top": F.max(w), "bottom": F.min(w), "mean": F.avg(w), "dev": F.stddev_pop(w), "weight": F.sum(w)}
    for a in IJK:
        out |= {f"lo_{a}": F.min(a), f"hi_{a}": (F.max(a) + F.lit(1)).cast("int"), f"mid_{a}": F.avg(a), f"pull_{a}": F.sum(w * F.col(a))}
        out |= {f"c_{a}{b}": F.covar_pop(a, b) for b in IJK if b >= a}
    return out


@dataclass(frozen=True)
class Property:
    needs: tuple[str, ...]
    value: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(f"_{name}")


def _each(make: Callable[[str], Column]) -> Column:
    return F.array(*[make(a).cast("double") for a in IJK])


def _volume() -> Column:
    return math.prod([(_c(f"hi_{a}") - _c(f"lo_{a}")).cast("bigint") for a in IJK], start=F.lit(1).cast("bigint"))


def _pulled(a: str) -> Column:
    return F.try_divide(_c(f"pull_{a}"), _c("weight"))


def _inertia() -> dict[str, Column]:
    spread = _c("c_ii") + _c("c_jj") + _c("c_kk")
    return {**{f"inertia_{a}{a}": spread - _c(f"c_{a}{a}") for a in IJK},
            "inertia_ij": -_c("c_ij"), "inertia_ik": -_c("c_ik"), "inertia_jk": -_c("c_jk")}


def _tensor() -> Column:
    t = _inertia()
    return F.array(*[t[f"inertia_{min(a, b)}{max(a, b)}"].cast("double") for a in IJK for b in IJK])


_BOX = tuple(f"{e}_{a}" for a in IJK for e in ("lo", "hi"))
_MID, _PULL = tuple(f"mid_{a}" for a in IJK), ("weight", *(f"pull_{a}" for a in IJK))
_SECOND = tuple(f"c_{a}{b}" for a in IJK for b in IJK if b >= a)
_LOW = tuple(f"lo_{a}" for a in IJK)
#: These come from the tensor by :func:`regions.axes_columns`.
_AXES = {"inertia_tensor_eigvals", "axis_major_length", "axis_minor_length"}

REGISTRY: dict[str, Property] = {
    "area": Property(("n",), lambda: _c("n")),
    "bbox": Property(_BOX, lambda: F.array(*[_c(f"{e}_{a}") for e in ("lo", "hi") for a in IJK])),
    "slice": Property(_BOX, lambda: F.array(*[F.struct(_c(f"lo_{a}").alias("start"), _c(f"hi_{a}").alias("stop"),
                                                        F.lit(None).cast("int").alias("step")) for a in IJK])),
    "area_bbox": Property(_BOX, _volume),
    "extent": Property(("n", *_BOX), lambda: _c("n") / _volume()),
    "equivalent_diameter_area": Property(("n",), lambda: F.pow(F.lit(6.0 / math.pi) * _c("n"), F.lit(1.0 / 3.0))),
    "centroid": Property(_MID, lambda: _each(lambda a: _c(f"mid_{a}"))),
    "centroid_local": Property((*_MID, *_LOW), lambda: _each(lambda a: _c(f"mid_{a}") - _c(f"lo_{a}"))),
    "centroid_weighted": Property(_PULL, lambda: _each(_pulled)),
    "centroid_weighted_local": Property((*_PULL, *_LOW), lambda: _each(lambda a: _pulled(a) - _c(f"lo_{a}"))),
    "inertia_tensor": Property(_SECOND, _tensor),
    "inertia_tensor_eigvals": Property(_SECOND, lambda: F.array("_eig_1", "_eig_2", "_eig_3")),
    "axis_major_length": Property(_SECOND, lambda: F.col("_axis_major_length")),
    "axis_minor_length": Property(_SECOND, lambda: F.col("_axis_minor_length")),
    "intensity_max": Property(("top",), lambda: _c("top")),
    "intensity_min": Property(("bottom",), lambda: _c("bottom")),
    "intensity_mean": Property(("mean",), lambda: _c("mean")),
    "intensity_std": Property(("dev",), lambda: _c("dev")),
}


def register(name: str, needs: tuple[str, ...], value: Callable[[], Column]) -> None:
    """Add a property whose value follows from the running aggregates *needs*, read as columns with a leading underscore."""
    if name in REGISTRY:
        raise ValueError(f"property {name!r} is there already")
    REGISTRY[name] = Property(tuple(needs), value)


def measure(labelled: DataFrame, by: list[str], names: list[str] | None = None, extra: dict[str, Column] | None = None,
            value: str = "agfe") -> DataFrame:
    """``by`` and a column ``geom_<name>`` for each named property of each region, all of them by default.

    *extra* are aggregate columns over the voxels of a region, computed in the same grouping.  Names nobody knows are an error.
    """
    names = list(REGISTRY) if names is None else list(dict.fromkeys(names))
    extra = dict(extra or {})
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"no region property {unknown}; there are {sorted(REGISTRY)}")
    clash = sorted(set(names) & set(extra))
    if clash:
        raise ValueError(f"named both as own and as known properties: {clash}")
    there, wanted = _aggregates(value), dict.fromkeys(n for p in names for n in REGISTRY[p].needs)
    missing = [n for n in wanted if n not in there]
    if missing:
        raise ValueError(f"no running aggregate {missing}; there are {sorted(there)}")
    aggs = [there[n].alias(f"_{n}") for n in wanted] + [c.alias(PREFIX + n) for n, c in extra.items()]
    rows = labelled.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
    if _AXES & set(names):
        tensor = rows.withColumns(_inertia())
        made = regions.axes_columns(tensor)
        rows = made.withColumns({f"_{c}": F.col(c) for c in ("eig_1", "eig_2", "eig_3", "axis_major_length", "axis_minor_length")})
    return rows.select(*by, *[REGISTRY[n].value().alias(PREFIX + n) for n in names], *[PREFIX + n for n in extra])


def _plain(column: Column, kind: T.DataType) -> Column:
    """A value as JSON can hold it: slices as start, stop and step, nested lists flat, what is not finite as null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)
    if isinstance(kind, T.StructType):
        return F.array(*[_plain(column[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.ArrayType):
            return _plain(F.flatten(column), kind.elementType)
        return F.transform(column, lambda x: _plain(x, kind.elementType))
    return column


def serialised(rows: DataFrame, by: list[str], name: str = "properties") -> DataFrame:
    """All other columns as one JSON object per row; absent and non-finite values are null."""
    cols = [f for f in rows.schema.fields if f.name not in by]
    return rows.select(*by, F.to_json(F.struct(*[_plain(F.col(f.name), f.dataType).alias(f.name) for f in cols]),
                                      {"ignoreNullFields": "false"}).alias(name))
