"""Bounded keyword search against scoring every match."""

import random

import pytest

from veridoc.operators import bounded as bd
from veridoc.operators import keyword as kw


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]  # w0 to w2 are in most rows
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(3000)]
    docs += [(i + 10000, docs[0][1]) for i in range(40)]  # ties
    docs += [(20000, None), (20001, ""), (20002, "w250 " * 3000)]
    tokens = kw.tokenised(spark.createDataFrame(docs, "id long, text string"), "id", ["text"])
    folder = tmp_path_factory.mktemp("bounds")
    plain = kw.save_index(tokens, f"{folder}/plain")
    return plain, bd.save_bounds(plain, f"{folder}/bounded")


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(12)
    data = [(q, f"w{rng.choice((0, 1, 2, 3, rng.randint(4, 299)))}") for q in range(40) for _ in range(rng.randint(1, 12))]
    data += [(100, "w0"), (101, "nowhere"), (102, "w299"), (102, "w299"), (103, None)]
    return spark.createDataFrame(data, "query_id long, token string")


@pytest.mark.parametrize("k", [1, 12, 5000])
def test_ranks_are_those_of_scoring_everything(indexes, questions, k):
    plain, index = indexes
    assert rows(bd.bm25_top_k(index, questions, k)) == rows(kw.top_k(kw.bm25_scores(plain, questions), k))


def test_restricted_rows(spark, indexes, questions):
    plain, index = indexes
    allowed = spark.range(0, 20003, 7).select("id")
    assert rows(bd.bm25_top_k(index, questions, 12, allowed)) == rows(kw.top_k(kw.bm25_scores(plain, questions, allowed), 12))
    assert bd.bm25_top_k(index, questions, 12, allowed.limit(0)).count() == 0


def test_frequent_words_are_mostly_passed_over(indexes, questions):
    share = bd.share_scored(indexes[1], questions, 12).first()
    assert 0 < share.searched < share.matched and share.share < 0.6
    assert bd.share_scored(indexes[1], questions.limit(0), 12).first().matched == 0


def test_empty_index(spark, tmp_path, questions):
    docs = spark.createDataFrame([], "id long, text string")
    index = bd.save_bounds(kw.save_index(kw.tokenised(docs, "id", ["text"]), str(tmp_path / "a")), str(tmp_path / "b"))
    assert bd.bm25_top_k(index, questions, 3).count() == 0
