"""Every registered query against its DuckDB SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tabclean.sources.tables import TABLES

from conftest import SF_SMALL

QUERIES = E.queries()
SQL = E.oracle_sql()


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["price", "prio", "odate", "cust_txt"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(SQL[name])
    d_cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(d_cols, cur.fetchall())


def test_every_query_of_the_reference_has_an_oracle():
    """Only those of the optional subpackage may be checked otherwise (by their own tests)."""
    from tabclean.plans.registry import QUERIES as OWN
    assert set(OWN) <= set(SQL)
