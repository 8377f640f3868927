"""Staged ingestion: decisions per document, reuse of earlier stages, redelivery."""

import pytest
from pyspark.sql import functions as F

from veridoc.operators import indexstate as ix
from veridoc.operators import keyword
from veridoc.plans.index import CONFIG
from veridoc.sources import buckets as bk
from veridoc.streaming import stages

TEXTS = {"a": "First title\n\nalpha beta gamma", "b": "alpha alpha", "c": "", "d": "alpha alpha", "e": None}


def deliver(spark, store, texts, config=CONFIG, batch=0, run="r"):
    rows = [("upload", k, t) for k, t in texts.items()]
    stages.ingest_staged_batch(spark.createDataFrame(rows, "source_type string, source_key string, text string"), batch, store, config, run)


def decisions(spark, store):
    return {r["source_key"]: (r["start_stage"], r["reason"], r["stage"], r["batch"]) for r in bk.read_table(spark, store, "state").collect()}


def content(spark, store, name):
    return sorted((tuple(r) for r in bk.read_table(spark, store, name).collect()), key=str)


def versions(spark, store, name):
    return bk.current_state(spark, store)[1][name].versions


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("stages") / "store")
    stages.open_store(spark, store, 8)
    deliver(spark, store, TEXTS)
    return store


def test_deliveries_decide_and_reuse(spark, filled):
    store = filled
    assert decisions(spark, store) == {k: ("none", "new", "completed", 0) for k in TEXTS}
    first = {name: content(spark, store, name) for name in ("chunks", "vectors", "postings")}
    chunks = bk.read_table(spark, store, "chunks")
    assert {r[0] for r in chunks.filter("text LIKE 'alpha alpha%'").select(F.substring_index("doc_key", stages.dg.UNIT_SEPARATOR, -1)).collect()} == {"b", "d"}
    assert len({c for _, c, _ in first["chunks"]}) < len(first["chunks"])  # b and d share a content
    assert sorted(set((k, c) for k, c, _ in first["chunks"])) == sorted((k, c) for k, c, _ in first["vectors"])
    want = keyword.build_postings(keyword.tokenised(chunks.withColumn("i", F.struct("doc_key", "chunk_id")), "i", ["text"]))
    assert len(first["postings"]) == want.count()

    # the same batch again, and the same documents in another batch: nothing is written
    before = bk.current_state(spark, store)
    deliver(spark, store, TEXTS)
    deliver(spark, store, TEXTS, batch=7)
    assert bk.current_state(spark, store) == before

    # a new keyword schema leaves chunks and vectors where they are
    words = CONFIG | {"keyword_schema": {"version": "2", "tokenizer": "unicode"}}
    deliver(spark, store, {"a": TEXTS["a"], "b": "changed text"}, words, 1)
    got = decisions(spark, store)
    assert got["a"] == ("vector_indexed", "keyword_schema_changed", "completed", 1)
    assert got["b"] == ("none", "content_changed", "completed", 1)
    assert got["c"] == ("none", "new", "completed", 0)
    rest = [r for r in content(spark, store, "vectors") if r in first["vectors"]]
    assert len(rest) == len(first["vectors"]) - 1
    assert [r for r in content(spark, store, "chunks") if r[2] == "changed text"]

    # a new chunker cuts again; a new embedding keeps the chunks
    vectors = words | {"embedding": {"provider": "hash", "dimension": 65}}
    old_chunks = versions(spark, store, "chunks")
    deliver(spark, store, {"a": TEXTS["a"]}, vectors, 2)
    assert decisions(spark, store)["a"] == ("chunked", "embedding_changed", "completed", 2)
    assert versions(spark, store, "chunks") == old_chunks
    deliver(spark, store, {"a": TEXTS["a"]}, vectors | {"chunker": {"version": "2"}}, 3)
    assert decisions(spark, store)["a"] == ("parsed", "chunker_changed", "completed", 3)
    assert sorted(r[:2] for r in content(spark, store, "chunks")) == sorted(r[:2] for r in content(spark, store, "vectors"))


def test_incomplete_stage_is_taken_up_again(spark):
    marks = ix.fingerprint_columns(CONFIG)
    state = spark.range(1).select(
        F.lit("k").alias("doc_key"), F.lit("s").alias("sha256"), F.lit("chunked").alias("stage"), F.lit("none").alias("start_stage"), F.lit("new").alias("reason"),
        F.lit("r").alias("run"), F.lit(0).alias("batch"), *[marks[n].alias(n) for n in ix.FINGERPRINTS],
    )
    row = stages.decide(spark.createDataFrame([("k", "s")], "doc_key string, sha256 string"), state, marks).first()
    assert (row["start_stage"], row["reason"]) == ("chunked", "incomplete")


def test_empty_batch(spark, filled):
    before = bk.current_state(spark, filled)
    deliver_none = spark.createDataFrame([], "source_type string, source_key string, text string")
    stages.ingest_staged_batch(deliver_none, 9, filled, CONFIG, "r")
    assert bk.current_state(spark, filled) == before
