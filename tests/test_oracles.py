"""Every registered query against its DuckDB oracle (the driver's correctness gate), at sf0.001."""

import math
import os

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as E
from ridgeline.workload.oracles import oracle_sql
from ridgeline.workload.queries import QUERIES

TABLES = ["lineitem", "embeddings", "documents"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "__float__") and not isinstance(v, (bool, int)):
        return repr(float(v) + 0.0)
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    return c


def test_every_oracle_names_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(QUERIES) <= set(E.queries())


def test_earlier_queries_stay():
    assert "gradient_vector_form" in set(E.queries()) & set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert _canon(df.columns, rows) == _canon(ocols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["feature_index", "feature", "weight"]
    assert [r.feature for r in rows] == ["qty", "bias"]
    assert all(math.isfinite(r.weight) for r in rows)
