"""Every text query with an SQL twin matches DuckDB; the others return a row for each input row."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle_harness import compare, duck  # noqa: E402

from facsimile.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    r = compare(spark, duck(SF), name, Q.queries()[name], Q.oracle_sql()[name], SF)
    assert r["ok"], r


def test_sql_names():
    assert set(Q.oracle_sql()) <= set(Q.queries()) and len(Q.queries()) == 14


ROWS = {"op1_language_id": "documents", "op2_html_extraction": "pages", "op3_token_counts": "documents", "op4_simhash": "documents",
        "op5_token_files": "documents", "op8_lm_scores": "documents", "op10_toxicity": "documents"}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_a_row_for_each_input_row(spark, name):
    """Queries without SQL return every id of their table once; their values are tested against brute force."""
    got = Q.queries()[name](spark, SF)
    key = "page_id" if ROWS[name] == "pages" else "doc_id"
    want = spark.read.parquet(f"{SF}/{ROWS[name]}.parquet").select(key)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in want.collect())


def test_whitening_has_a_row_for_each_vector_and_component(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert Q.op12_embedding_whitening(spark, SF).groupBy("component").count().where(f"count = {n}").count() == 32


def test_packing_holds_every_document_once(spark):
    got = Q.op7_best_fit_packing(spark, SF).toPandas()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.piece == 0).sum() == got.doc_id.nunique() == n
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
