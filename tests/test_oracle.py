"""Every registered query of the package's own operators against its SQL, on the smallest tables."""

import datetime
import glob
import math
from pathlib import Path

import duckdb
import pytest

from dqspark import plans

SPARK, SQL = plans.queries(), plans.oracle_sql()


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, duck, name):
    df = SPARK[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(SPARK) - set(SQL)))
def test_rows_only(spark, small, name):
    assert SPARK[name](spark, small).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
