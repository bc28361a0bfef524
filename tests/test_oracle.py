"""Every catalogue query against its DuckDB oracle on the sf0.001 tables."""

import os
import sys

import pytest

from support import ROOT, SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from mealops.plans.catalog import ORACLES, QUERIES  # noqa: E402

from check_oracle import TABLES, duck_type, rows_of, spark_type  # noqa: E402

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES) <= set(E.queries())
    assert len(NAMES) >= 100


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    d_cols, d_types, d_rows = rel.columns, [duck_type(t) for t in rel.types], rel.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert dict(zip(df.columns, [spark_type(f.dataType) for f in df.schema.fields])) == dict(zip(d_cols, d_types))
    assert rows_of(df.columns, s_rows) == rows_of(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "report_date"
    df.collect()
