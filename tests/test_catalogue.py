"""Every registered query with SQL gives the same rows in DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = con.execute(catalogue.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(out.description)}
    assert sorted(at) == columns
    assert sorted((tuple(plain(r[at[c]]) for c in columns) for r in out.fetchall()), key=repr) == got


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["pricing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan and "l_partkey" not in plan


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
