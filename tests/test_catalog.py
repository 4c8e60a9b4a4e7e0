"""Every query with an SQL equivalent against DuckDB on the smallest corpus, and the entry contract."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

CORPUS = os.environ.get("FOLIOFLOW_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(CORPUS).exists(), reason="no test corpus")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in Path(CORPUS).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    frame = entry.queries()[name](spark, CORPUS)
    relation = sql.sql(entry.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    order = [relation.columns.index(c) for c in frame.columns]
    got = sorted(str(tuple(map(comparable, r))) for r in frame.collect())
    want = sorted(str(tuple(comparable(r[i]) for i in order)) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    rows = entry.queries()[name](spark, CORPUS).collect()
    assert rows and len(rows[0]) == len(set(rows[0].asDict()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_field", "row_id", "ref_month", "ref_state"]
