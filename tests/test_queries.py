"""Every registered query of the core against its SQL on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

from cvloom.plans.catalogue import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return repr(float(v)) if v.__class__.__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, sql, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    cursor = sql.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    want = sorted("|".join(plain(row[names.index(c)]) for c in cols) for row in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
