"""Where queries meet their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelloom.sources.tables import ORACLE_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KT = "cast('0.59616123' as double)"

# Derived views: occupancy, raw free energy, favourable voxels and their components.
VIEWS = dict(ORACLE_VIEWS)
VIEWS.update({
    "hist": """hist AS (
  SELECT probe, CAST(floor(x / 2.5e0) AS INT) AS i, CAST(floor(y / 2.5e0) AS INT) AS j,
    CAST(floor(z / 2.5e0) AS INT) AS k, count(*) AS n FROM positions GROUP BY ALL)""",
    "rhist": """rhist AS (
  SELECT probe, replica, CAST(floor(x / 2.5e0) AS INT) AS i, CAST(floor(y / 2.5e0) AS INT) AS j,
    CAST(floor(z / 2.5e0) AS INT) AS k, count(*) AS n FROM positions GROUP BY ALL)""",
    "thist": """thist AS (
  SELECT probe, atype, CAST(floor(x / 2.5e0) AS INT) AS i, CAST(floor(y / 2.5e0) AS INT) AS j,
    CAST(floor(z / 2.5e0) AS INT) AS k, count(*) AS n FROM positions GROUP BY ALL)""",
    "tot": "tot AS (SELECT probe, sum(n) / 50e0 AS n_atoms FROM hist GROUP BY probe)",
    "rtot": "rtot AS (SELECT probe, replica, sum(n) / 50e0 AS n_atoms FROM rhist GROUP BY ALL)",
    "ttot": "ttot AS (SELECT probe, atype, sum(n) / 50e0 AS n_atoms FROM thist GROUP BY ALL)",
    "agfe": f"""agfe AS (
  SELECT probe, i, j, k, n, -{KT} * ln(greatest(n / 50e0, 1e-10) / (n_atoms / 8000e0)) AS agfe
  FROM hist JOIN tot USING (probe))""",
    "ragfe": f"""ragfe AS (
  SELECT probe, replica, i, j, k, -{KT} * ln(greatest(n / 50e0, 1e-10) / (n_atoms / 8000e0)) AS agfe
  FROM rhist JOIN rtot USING (probe, replica))""",
    "tagfe": f"""tagfe AS (
  SELECT probe, atype, i, j, k, -{KT} * ln(greatest(n / 50e0, 1e-10) / (n_atoms / 8000e0)) AS agfe
  FROM thist JOIN ttot USING (probe, atype))""",
    "fav": f"""fav AS (
  SELECT probe, i, j, k, (i * 1000 + j) * 1000 + k AS vid, n, agfe FROM agfe WHERE agfe < -{KT})""",
    "edges26": """edges26 AS (
  SELECT a.probe, a.vid AS u, b.vid AS v FROM fav a JOIN fav b ON a.probe = b.probe
    AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 AND a.vid <> b.vid)""",
    "edges6": """edges6 AS (
  SELECT a.probe, a.vid AS u, b.vid AS v FROM fav a JOIN fav b ON a.probe = b.probe
    AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1)""",
    "reach26": """reach26(probe, u, r) AS (
  SELECT probe, vid, vid FROM fav UNION
  SELECT x.probe, e.v, x.r FROM reach26 x JOIN edges26 e ON e.probe = x.probe AND e.u = x.u)""",
    "reach6": """reach6(probe, u, r) AS (
  SELECT probe, vid, vid FROM fav UNION
  SELECT x.probe, e.v, x.r FROM reach6 x JOIN edges6 e ON e.probe = x.probe AND e.u = x.u)""",
})
for _c in ("26", "6"):
    VIEWS[f"lab{_c}"] = f"""lab{_c} AS (
  SELECT f.*, CAST(dense_rank() OVER (PARTITION BY f.probe ORDER BY root) AS INT) AS label,
    count(*) OVER (PARTITION BY f.probe, root) AS n_voxels
  FROM fav f JOIN (SELECT probe, u AS vid, min(r) AS root FROM reach{_c} GROUP BY ALL) USING (probe, vid))"""
# Hotspots of the fixture: 26-connected favourable components of at least 8 voxels.
VIEWS["hot"] = "hot AS (SELECT * FROM lab26 WHERE n_voxels >= 8)"

_NEEDS = {
    "hist": ["positions"], "rhist": ["positions"], "thist": ["positions"], "tot": ["hist"],
    "rtot": ["rhist"], "ttot": ["thist"], "agfe": ["hist", "tot"], "ragfe": ["rhist", "rtot"],
    "tagfe": ["thist", "ttot"], "fav": ["agfe"], "edges26": ["fav"], "edges6": ["fav"],
    "reach26": ["edges26"], "reach6": ["edges6"], "lab26": ["reach26"], "lab6": ["reach6"],
    "hot": ["lab26"],
}


def view(name: str, needs: list[str], body: str) -> None:
    """Add a shared oracle view."""
    VIEWS[name] = f"{name} AS ({body})"
    _NEEDS[name] = needs


def raw_view(name: str, needs: list[str], text: str) -> None:
    """Add a shared oracle view given with its own head (a recursive one)."""
    VIEWS[name] = text
    _NEEDS[name] = needs


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n):
        for d in _NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " + ",\n".join(VIEWS[n] for n in order) + "\n" + body) if order else body


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Register a query, with its oracle where SQL can say it."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views or [], sql)
        return fn
    return keep
