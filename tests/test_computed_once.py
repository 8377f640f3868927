"""Costly columns are computed once per row, and their rows are dealt out to all cores."""

import re

import pytest

from pyspark.sql import functions as F

from veridoc.operators import blocks as bl
from veridoc.operators import keyword, matching
from veridoc.plans import preparation as prep
from veridoc.plans import runner
from veridoc.session import Tables

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_a_row_are_made_once(spark):
    docs = spark.createDataFrame([(1, "# a\nb\n\nc"), (2, ""), (3, None)], "id long, text string")
    blocks = bl.extract_blocks(docs, "id", "text")
    assert plan_of(blocks).count(r"[\x01-\x05]") == 1
    assert sorted((r.doc_id, r.block_index, r.text) for r in blocks.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_customer_sheets_are_dealt_out(spark):
    sheets = prep.markdown_docs(Tables(spark, DATA)).where(F.col("doc_id") >= 10_000_000_000)
    assert sheets.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_words_of_a_row_are_made_once(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "")], "id long, text string")
    postings = keyword.row_postings(keyword.tokenised(docs, "id", ["text"], cjk=False))
    assert plan_of(postings).count(r"[^\p{L}\p{N}\p{Co}]+") == 1
    assert sorted((r.term, r.id, r.tf) for r in postings.collect()) == [("fox", 1, 1), ("red", 1, 2)]


def test_index_is_stored_without_shuffling_postings(spark, tmp_path):
    rows = [(1, "red fox red"), (2, "red"), (1, "fox"), (3, "blue"), (None, "red"), (None, "red fox")]
    docs = spark.createDataFrame(rows, "id long, text string")
    tokens = keyword.tokenised(docs, "id", ["text"])
    saved, built = keyword.save_index(tokens, str(tmp_path / "index")), keyword.build_index(tokens)
    assert "Exchange" not in saved.postings._jdf.queryExecution().executedPlan().toString()
    for name, columns in (("postings", ["term", "id", "tf"]), ("terms", ["term", "df"]), ("totals", ["n", "avgdl"])):
        a, b = ([tuple(r) for r in getattr(i, name).select(*columns).collect()] for i in (saved, built))
        assert sorted(a, key=str) == sorted(b, key=str)


def test_pairs_of_queries_and_rows_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red"), (3, "blue")], "id long, text string")
    index = keyword.save_index(keyword.tokenised(docs, "id", ["text"]), str(tmp_path / "index"))
    q = spark.createDataFrame([(7, "red"), (7, "fox"), (8, "blue"), (8, "blue")], "query_id long, token string")
    scores = keyword.bm25_scores(index, q)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan), plan
    assert sorted((r.query_id, r.id) for r in scores.collect()) == [(7, 1), (7, 2), (8, 3)]
    allowed = spark.createDataFrame([(2,), (2,)], "id long")
    assert [(r.query_id, r.id) for r in keyword.bm25_scores(index, q, allowed).collect()] == [(7, 2)]


@pytest.mark.parametrize("name", ["rerank_merge"])
def test_retrieval_runs_once_for_all_joins(spark, name):
    plan = runner(name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "keyword-" not in plan and "embeddings.parquet" not in plan


def test_gram_candidates_are_counted_on_hits_only(spark):
    texts = spark.createDataFrame([(1, "x" * 7 + "a long needle that is surely over forty characters" + "y" * 9), (2, "short"), (3, None)], "id long, text string")
    needles = spark.createDataFrame([(9, "a long needle that is surely over forty characters"), (8, "sho"), (7, "")], "needle_id long, needle string")
    found = matching.containing(texts, needles)
    assert sorted(map(tuple, found.collect())) == [(1, 9), (2, 8)]


def test_warnings_are_made_once_for_their_evidence(spark):
    plan = runner("plan_warning_evidence")(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
