"""Every query of the catalogue against its SQL in DuckDB, at the smallest size."""

import glob
import os

import duckdb
import pytest
from provena.plans import catalog, inventory, stored  # noqa: F401  the others add their queries


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "None" if v is None else str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    want = db.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
