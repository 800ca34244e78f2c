"""Registered queries against their SQL on the smallest tables.

All of them take minutes (``python check.py`` runs them too), so by default one of each
family runs; set TEST_ALL_QUERIES=1 for the rest.
"""

import os

import duckdb
import pytest

import check
from voxelloom.plans.catalog import ORACLE, QUERIES

SOME = ["favorable_summary", "typed_total_rollup", "sampling_report", "agfe_smoothed", "mask_open_close", "merge_median",
        "grid_alignment", "cc_labels_26", "rerank_custom_weights", "survival_curve", "sp_half_life", "contacts",
        "rmsd_nofit", "box_bounds", "pdb_bonds", "stream_histogram"]


def test_registry():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 150
    assert not [n for n in SOME if n not in ORACLE]


@pytest.mark.parametrize("name", list(ORACLE) if os.environ.get("TEST_ALL_QUERIES") else SOME)
def test_query_matches_sql(spark, root, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    df = QUERIES[name](spark, root)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    want = sorted(tuple(check.norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(tuple(check.norm(r[c]) for c in cols) for r in df.collect()) == want


def test_entry_runs(spark, root):
    import __spark_entry__ as e
    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
