"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from barspark.queries import ORACLE_SQL, QUERIES


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return float(value) if type(value).__name__ == "Decimal" else value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = duck.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    theirs = ordered([tuple(plain(r[i]) for i in at) for r in result.fetchall()])
    ours = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=2e-4) if all(isinstance(v, float) for v in a) else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-4) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).columns
    QUERIES[name](spark, small).count()
