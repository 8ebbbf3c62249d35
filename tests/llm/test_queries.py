"""Registered queries against the SQL that says the same."""

import glob
import os

import duckdb
import pytest

from barspark.llm.queries import ORACLE_SQL, QUERIES


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(df, result):
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    order = lambda r: tuple((v is None, v) for v in r)
    theirs = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=order)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order) == theirs


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), duck(sf).sql(ORACLE_SQL[name]))


def test_links_of_odd_texts_are_those_of_sql(spark, tmp_path):
    base = [f"w{k}" for k in range(60)]
    far = [*base[:30], "other", *base[31:]]
    near = [*base[:-1], "End"]
    texts = [None, "", " \n\t", "One two", "one  TWO", "one two three", " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far), "ÉTÉ a b c d", "été a b c d"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(6, " ".join(base)), (None, " ".join(far)), (None, "alone here")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(f"{path}/documents.parquet")
    same(QUERIES["op9_t_occurrence_join"](spark, path), duck(path).sql(ORACLE_SQL["op9_t_occurrence_join"]))
