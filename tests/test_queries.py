"""Registered queries against their SQL on the smallest test tables."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from paretide.plans.registry import ORACLES

SF = "/root/testdata/sf0.001"
CORE = sorted(ORACLES)
#: Its SQL needs four distinct values a key.
LARGER = {"kmeans_1d": "/root/testdata/sf0.01"}


def _plain(value):
    """Numbers to six digits, as sums of doubles depend on their order; all else as it is."""
    return round(float(value), 6) if isinstance(value, (float, Decimal)) else value


def _rows(rows):
    return sorted((tuple(_plain(x) for x in row) for row in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    sf = LARGER.get(name, SF)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    got = __spark_entry__.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.select(*[f"`{c}`" for c in columns]).collect()) == _rows(want)


def test_names_are_known():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
