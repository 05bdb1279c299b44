"""Every query that has SQL, against DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from loomframe import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(float(v), 4) if isinstance(v, float | Decimal) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = duck.execute(catalog.SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert catalog.entry(spark).count() > 0
