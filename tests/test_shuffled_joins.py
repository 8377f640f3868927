"""Tables that grow with the input are never sent whole through the driver."""

import re

import pytest

from pyspark.sql import functions as F

from veridoc.operators import keyword
from veridoc.plans import runner
from veridoc.streaming import jobs

DATA = "/root/testdata/sf0.001"


def broadcast_subtrees(df):
    """The subtrees below each broadcast of the physical plan, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:|+\-*()\d]*", line).group()) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1:end])


@pytest.mark.parametrize("name", [
    "plan_credits", "plan_totals", "plan_category_gaps", "plan_missing", "plan_missing_evidence", "plan_warnings", "plan_warning_rows",
    "plan_warning_items", "plan_warning_evidence", "plan_time_warnings", "plan_assembly", "plan_invariants", "plan_diff",
])
def test_audit_broadcasts_reduced_sides_only(spark, name):
    # rule sets, categories and required courses are aggregates of bounded size; pairs, records and the catalogue are rows of the input
    whole = [tree for tree in broadcast_subtrees(runner(name)(spark, DATA)) if "Aggregate" not in tree]
    assert not whole, whole[0]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_words_of_a_row_are_counted_without_shuffle(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["é"]), (1, ["a"]), (4, None)]
    tokens = spark.createDataFrame(rows, "id bigint, tokens array<string>").withColumn("dl", F.lit(3))
    counted = keyword.row_postings(tokens)
    assert exchanges(counted) == 0
    assert sorted(map(tuple, counted.collect())) == [("a", 1, 1, 3), ("a", 1, 1, 3), ("b", 1, 2, 3), ("é", 3, 1, 3)]
    assert sorted(map(tuple, keyword.build_postings(tokens).collect())) == [("a", 1, 2, 3), ("b", 1, 2, 3), ("é", 3, 1, 3)]


def test_chunks_meet_their_document_without_shuffle(spark):
    docs = spark.createDataFrame([(1, "demo", "a", "s1", "one. two."), (1, "demo", "a", "s2", "three.")], "doc_id bigint, source_type string, source_key string, sha256 string, text string")
    chunks = jobs.prepare(docs)
    assert exchanges(chunks) == 0
    assert sorted((r.doc_id, r.text) for r in chunks.collect()) == [(1, "one. two."), (1, "three.")]
    assert chunks.select("chunk_id").distinct().count() == 2


def test_query_plans_are_not_broadcast(spark):
    """A plan grows with the queries, and so do its sizes per conjunct; few input bytes do not make it small."""
    queries = spark.range(3).select("id", F.lit("alpha beta-gamma").alias("text"))
    plan = keyword.match_plan(queries, "id", "text")
    assert not list(broadcast_subtrees(plan))
    assert plan.where("mode = 'and'").count() == 9
