"""Every query that has SQL against that SQL in DuckDB, on the smallest tables."""

import importlib.util

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


def canonical(frame):
    def cell(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in row) for row in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    got = entry.queries()[name](spark, small).toPandas()
    assert canonical(got) == canonical(duck.sql(SQL[name]).df())


def test_registration():
    assert set(SQL) <= set(entry.queries())
    if importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in entry.queries()


def test_entry(spark, small):
    assert {r.status for r in entry.entry(spark).collect()} <= {"pass", "fail", "insufficient-data"}
