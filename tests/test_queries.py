"""Every query with SQL gives the rows that DuckDB gives for it, on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from millrace.plans import registry


@pytest.fixture(scope="module")
def views(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_against_sql(spark, small, views, name):
    df = registry.QUERIES[name](spark, small)
    want = views.sql(registry.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = rounded(tuple(r) for r in df.select(*columns).collect())
    assert got == rounded(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Chains of hashes are folded in order, and texts beyond ASCII normalized, by Arrow functions; markers and rules that no key can find are few, which is counted first, and
#: single rows, or a handful of defaults, go to all tasks.
IN_PYTHON = {"running_prefix", "rebuilt_evidence", "normalized_duplicates"}
NESTED_LOOPS = {"benchmark_containment", "scope_verdicts", "leakage_scan", "tree_changes", "bounded_tree", "included_settings"}


def test_no_cartesian_products(spark, small):
    for name, query in registry.QUERIES.items():
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert name in NESTED_LOOPS or "BroadcastNestedLoopJoin" not in plan, name
        assert name in IN_PYTHON or "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan, name
