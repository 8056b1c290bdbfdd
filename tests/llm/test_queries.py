"""The opN queries and the pipeline: SQL where there is any, contracts otherwise."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from siftwood.llm import language_id, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_pipeline(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["language_id", "simhash", "decontamination", "personal_data", "mixing"]
    odd = [(90_001, None, None, None, None), (90_002, "", "en", "src1", 0), (90_003, "reach me at joe@example.com today please", "en", "src1", 40)]
    odd += [(90_010 + k, "a very plain text that repeats itself in two rows of the table without any change", "en", "src2", 81) for k in range(2)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("text2", F.lit("x"))
    for name, stage in c.STAGES[:-1]:
        rows = stage(spark, rows, DATA).cache()
        assert rows.columns == [*docs.columns, "text2"], name
    left = {r.doc_id: r.text for r in rows.filter("doc_id >= 90000").collect()}
    assert left == {90_003: "reach me at <EMAIL> today please", 90_010: odd[3][1]}
    got = c.run(spark, DATA)
    assert got.count() > 0 and got.select("doc_id").distinct().count() == got.count()
    assert got.filter("tokens <= 0").count() == 0
