"""Every registered query against its SQL, over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tramline.plans import registry
from tramline.plans.projections import TABLES


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_sql(spark, small, db, name):
    df = registry.queries()[name](spark, small)
    rel = db.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    at = [rel.columns.index(c) for c in order]
    ours = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert ours == theirs
