"""Stages keep columns of any name, and take empty tables and rows of nulls."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from veridoc.llm import decontaminate, mixing, near_dedup
from veridoc.llm.common import put_back, set_aside

BASE = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = [*mixing.WORKING, *mixing.ADDED, *cp.MIX_COLUMNS.values(), "_GONE_ID", "_gone_digest", "_kept_id", "_kept_digest", "_row", "_m", "kept_0", "digest", "component"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten " * 9, "", None, "alpha beta gamma delta epsilon zeta eta"]
    rows = [(i if i != 3 else None, t, None if i == 4 else "en", None if i == 2 else "web", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], BASE).withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in CLASHES})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    items = ["alpha beta gamma delta epsilon zeta eta"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def untouched(df, but=()):
    """Every clashing column still says its own name and id."""
    rows = df.collect()
    return all(r[c] == f"{c}-{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES if c not in but) and rows


def test_set_aside_and_back(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_Key int, kept_0 int, other int")
    moved_df, moved = set_aside(df, ("_key", "_cell"))
    assert moved_df.columns == ["kept_0_", "kept_0", "other"] and put_back(moved_df, moved).columns == df.columns


def test_clashing_columns(spark, docs, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and len(untouched(clean)) == 5
    single = near_dedup.one_of_each(docs)
    assert single.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in untouched(single)) == [(False, 0), (False, 2), (False, 4), (False, 5)]
    mixed = mixing.mix(docs)
    assert set(mixed.columns) == set(docs.columns) and len(untouched(mixed, mixing.ADDED)) == 7
    plain = mixing.mix(docs.drop(*CLASHES)).select("doc_id", *mixing.ADDED)
    assert sorted(map(repr, mixed.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_order_mix_keeps_what_it_does_not_add(spark, docs, folder):
    added = tuple(cp.MIX_COLUMNS.values())
    got = cp.order_mix(spark, docs, folder)
    assert got.columns == [c for c in docs.columns if c not in added] + list(added)
    rows = untouched(got, added)
    assert {r.doc_id for r in rows} <= {0, 1, 2, 5} and rows and all(r.mix_taken > 0 for r in rows)


def test_equal_ids_and_texts_that_differ_in_a_map(spark):
    docs = spark.createDataFrame([(1, "a b c d e", {"k": v}) for v in (1, 2, 3)], "doc_id long, text string, extra map<string,int>")
    kept = {str(near_dedup.one_of_each(d).collect()) for d in (docs, docs.orderBy(F.desc(F.col("extra")["k"])), docs.repartition(3))}
    assert len(kept) == 1


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_empty_tables_and_null_rows(spark, docs, folder, name):
    stage = dict(cp.STAGES)[name]
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0 and (name == "mixing" or empty.columns == docs.columns)
    nulls = spark.createDataFrame([(None,) * 5] * 2, BASE)
    want = {"quality": (0, 2), "near_dedup": (1,), "decontamination": (2,), "secrets": (2,), "mixing": (0,)}
    assert stage(spark, nulls, folder).count() in want[name]
