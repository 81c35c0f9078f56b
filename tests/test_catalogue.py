"""Every query against its SQL on the smallest tables, and invariants of the layers."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tenderlake.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 4))
    return str(x) if isinstance(x, (datetime.date, bool)) else repr(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    want = duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


def test_queries_without_sql():
    """A search by an index is held by a test of its own (test_vectors.py)."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"told_categories"}


def test_prefix_reaches_the_scan(spark, tmp_path):
    from tenderlake.sources.readers import decp

    spark.createDataFrame([("1", "72210000", "x")], "acheteur_id string, codeCPV string, objet string").write.parquet(str(tmp_path / "d"))
    plan = decp(spark, str(tmp_path / "d"), ["acheteur_id"], cpv_prefix="72")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(codeCPV,72)" in plan and "objet" not in plan
