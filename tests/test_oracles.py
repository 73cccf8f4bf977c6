"""Every plan that SQL expresses gives in Spark what DuckDB gives, row by row."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.operators import graph
from weftline.plans import more, site

DATA = os.environ.get("SITE_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 3)
    return int(value) if isinstance(value, bool) else float(value) if type(value).__name__ == "Decimal" else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(site.PLANS | graph.queries() | more.oracle_sql()))
def test_plan(spark, duck, name):
    ours = entry.queries()[name](spark, DATA)
    theirs = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())
