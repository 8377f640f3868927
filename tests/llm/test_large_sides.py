"""Sides of joins that grow with the documents are shuffled, however small the planner takes them to be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_shuffled_joins import broadcast_subtrees
from veridoc.llm import common
from veridoc.llm import decontaminate as dc
from veridoc.llm import near_dedup as nd


def test_keys_of_fingerprints_are_not_broadcast(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**62))
    classes = spark.createDataFrame([(centre ^ 1 << i,) for i in range(40)], "fp long")
    links = nd.links(classes)
    assert not list(broadcast_subtrees(links))
    assert {x for r in links.collect() for x in r} == {centre ^ 1 << i for i in range(40)}


def test_documents_meet_their_components_without_broadcast(documents, prose):
    text = prose(60)
    docs = documents([(1, text, "en", "a"), (2, text, "en", "a"), (3, prose(60), "en", "b"), (None, None, "en", "b")])
    found, kept = nd.near_duplicates(docs), nd.one_of_each(docs)
    assert not list(broadcast_subtrees(found)) and not list(broadcast_subtrees(kept))
    assert sorted((r.doc_id, r.component_id) for r in found.collect() if r.doc_id) == [(1, 1), (2, 1), (3, 3)]
    assert {r.doc_id for r in kept.collect()} == {1, 3, None}


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_ROWS", few)
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 3), (20, 21), (21, 22), (5, 5)], "a long, b long")
    assert sorted(map(tuple, common.components(edges).collect())) == [(3, 3), (7, 3), (8, 3), (9, 3), (20, 20), (21, 20), (22, 20)]


def test_windows_are_not_broadcast_to_a_large_index(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    item = prose(20)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents([(1, f"{prose(30)} {item} {prose(30)}", "en", "a"), (2, prose(50), "en", "a")])
    found = dc.leaks(docs, benchmark)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [tree for tree in broadcast_subtrees(found) if "block" in tree], plan
    assert [(r.doc_id, r.item_id) for r in found.select(F.col("doc_id"), "item_id").collect()] == [(1, 1)]


def test_near_dedup_stage_of_the_pipeline_broadcasts_nothing(spark, documents, prose):
    import corpus_pipeline

    text = prose(40)
    docs = documents([(5, text, "en", "a"), (4, text, "en", "a"), (6, prose(40), "en", "b")])
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert not list(broadcast_subtrees(kept))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6]
