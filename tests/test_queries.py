"""Each named query with SQL against an independent engine, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from panelcast.functions.lineage import materialise
from panelcast.plans import catalog
from panelcast.sources.star import monthly_panel

FOLDER = os.environ.get("PANELCAST_TESTDATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.QUERIES, entry_point.ORACLES  # those of llm have their own tests

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_panel(spark):
    """Build the panel once for all queries; it is itself one of the compared results."""
    built = {}

    def shared(session, folder, spec, entity="p_brand"):
        if (folder, entity) not in built:
            built[folder, entity] = materialise(monthly_panel(session, folder, spec, entity))
        return built[folder, entity]

    patch = pytest.MonkeyPatch()
    patch.setattr(catalog, "monthly_panel", shared)
    yield
    patch.undo()


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in places) for r in rows)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # no pairs of rows, and no Python between the scans and the result
    for word in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert word not in plan
    cursor = sql.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.collect()]
    assert ordered(got.columns, rows) == ordered(columns, cursor.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
