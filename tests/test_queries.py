"""Every query of the library gives the rows of its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from lathework.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else str(v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.SQL:
        assert got
        return
    found = duck.execute(catalog.SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
