"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    value = lambda v: None if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return cols, sorted(repr(tuple(value(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["page_aware_chunks", "layout_chunks", "query_plans", "challenge_cases", "unreliable_extraction"])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_imports_without_a_session():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_offline_answers_reads_whole_documents(spark, tmp_path):
    head = "Nothing of interest is told in the opening words of this text, which go on and on for a while. "
    spark.createDataFrame([(1, head + "The zebra quagga grazes near Kimberley."), (2, "Other words entirely.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zebra quagga grazes Kimberley")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.answer for r in QUERIES["offline_answers"](spark, f"file://{tmp_path}").collect()] == ["The zebra quagga grazes near Kimberley. [1]"]


def test_unreliable_extraction_reads_whole_texts(spark, tmp_path):
    head = "normal words stand at the beginning of every text here, "
    spark.createDataFrame([(2, head + "more normal words"), (5, head + "a b c d e f g")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.unreliable for r in QUERIES["unreliable_extraction"](spark, f"file://{tmp_path}").collect()} == {2: False, 5: True}
