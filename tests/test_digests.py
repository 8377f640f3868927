"""Digest trees, percentiles by counting and numbered lines against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veridoc.operators import digesttree as dt
from veridoc.operators import evaluation as ev
from veridoc.operators import indexstate as ix
from veridoc.sources import io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_only_leaves_with_a_difference_are_joined(spark):
    left = spark.range(20000).select(F.col("id").alias("k"))
    right = left.where("k not in (7, 900)").unionByName(spark.createDataFrame([(50000,)], "k long"))
    same, a, b = dt.compare(left, right, ["k"], F.lit(True), F.lit(True))
    moved = {7, 900, 50000}
    spots = {r.leaf for r in spark.createDataFrame([(m,) for m in moved], "k long").select(dt.leaf_of(["k"]).alias("leaf")).collect()}
    joined = left.where(dt.leaf_of(["k"]).isin(*spots))
    assert rows(a) == rows(joined) and a.count() < 10
    assert same.count() + a.count() == 20000 and b.count() == a.count() - 1
    assert rows(same.unionByName(a)) == rows(left)


def test_branches_add_up_their_leaves(spark):
    left = spark.range(3000).select(F.col("id").alias("k"))
    leaves = dt.leaves(left, ["k"], F.lit(True), "left")
    whole = leaves.agg(F.sum("n"), F.bit_xor("x"), F.sum("lo"), F.sum("hi")).first()
    assert tuple(whole) == tuple(dt.branches(leaves).agg(F.sum("n"), F.bit_xor("x"), F.sum("lo"), F.sum("hi")).first())
    assert dt.differing_leaves(leaves, dt.leaves(left, ["k"], F.lit(True), "right")).count() == 0
    assert dt.differing_leaves(leaves, leaves.limit(0)).count() == leaves.count()


def test_keyword_actions_with_nulls_and_empty_sides(spark):
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", None)], "doc_id string, chunk_id long")
    r = spark.createDataFrame(
        [("a", 1, "f"), ("a", 2, "old"), ("d", 4, "f"), (None, 1, "f"), ("b", 1, None)], "doc_id string, chunk_id long, fingerprint string"
    )
    want = [("a", 1, "keep"), ("a", 2, "refresh"), ("b", 1, "refresh"), ("c", None, "insert"), ("d", 4, "delete"), (None, 1, "delete"), (None, 1, "insert")]
    assert rows(ix.keyword_actions(e, r, F.lit("f"))) == sorted(want, key=repr)
    assert {x.action for x in ix.keyword_actions(e, r.limit(0), F.lit("f")).collect()} == {"insert"}
    assert {x.action for x in ix.keyword_actions(e.limit(0), r, F.lit("f")).collect()} == {"delete"}
    assert ix.keyword_actions(e.limit(0), r.limit(0), F.lit("f")).count() == 0


def test_set_facts_by_digest_equal_the_row_by_row_facts(spark):
    rng = random.Random(5)
    sets = []
    for p in (1.0, 0.97, 0.97):
        sets.append(spark.createDataFrame([(d, c, rng.random() < 0.95) for d in range(40) for c in range(d % 7) if rng.random() < p],
                                          "doc_id long, chunk_id long, current boolean"))
    c, v, k = sets
    c = c.drop("current")
    assert rows(ix.set_facts_by_digest(c, v, k)) == rows(ix.set_facts(c, v, k))
    assert rows(ix.set_facts_by_digest(c, v.limit(0), k)) == rows(ix.set_facts(c, v.limit(0), k))


@pytest.mark.parametrize("bins", [8, 1024])
def test_percentiles_equal_the_built_in_ones(spark, bins):
    rng = random.Random(bins)
    inf, nan = math.inf, math.nan
    groups = [
        [rng.gauss(0, 1) for _ in range(400)], [10.0 ** rng.randint(-300, 300) * rng.choice((-1, 1)) for _ in range(12)], [5e-324, 0.0, 1e-323, -5e-324],
        [1.7e308, -1.7e308, 1.0], [3.0] * 9, [4.0], [1.0, inf, -inf, nan, 2.0], [float(rng.randint(0, 3)) for _ in range(50)],
    ]
    points = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    for values in groups:
        df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        want = df.agg(*[F.percentile("x", p).alias(n) for n, p in points.items()]).first()
        got = ev.percentiles(df, "x", points, bins).first()
        assert repr(tuple(got)) == repr(tuple(want))
    assert tuple(ev.percentiles(df.limit(0), "x", points).first()) == (None,) * 5


def test_line_numbers_of_files_read_in_several_splits(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for name, n in (("a.txt", 900), ("b.txt", 1), ("c.txt", 0), ("d.txt", 400)):
        lines = ["" if rng.random() < 0.1 else f"{name} {i} " + "x" * rng.randint(0, 60) for i in range(n)]
        (tmp_path / name).write_text("".join(line + "\n" for line in lines))
        want += [(name, i, line) for i, line in enumerate(lines, 1)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 10
        got = io.numbered_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in got.collect()) == sorted(want)
