"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__
from plumbline.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 and not math.isinf(v) else f"{v:.6g}"
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    place = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in place) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["task", "model_id", "n", "correct", "accuracy", "source"] and df.count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
