"""AND and OR search cut to its best rows, against all matches ranked."""

import random

from veridoc.operators import keyword as kw
from veridoc.plans import runner

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_best_rows_are_those_of_all_matches(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 15)))) for i in range(400)] + [(900, "一二三四五六七八"), (901, "三四 w1")]
    asked = [(q, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for q in range(30)] + [(50, ""), (51, "nowhere"), (52, "w1 nowhere"), (53, "w0 w0"), (54, "一二三四五六七 w1")]
    index = kw.save_index(kw.tokenised(spark.createDataFrame(docs, "id long, text string"), "id", ["text"]), str(tmp_path / "i"))
    plan = kw.match_plan(spark.createDataFrame(asked, "id long, t string"), "id", "t")
    for allowed in (None, spark.range(0, 400, 3).select("id")):
        want = kw.top_k(kw.keyword_matches(index, plan, allowed), 5, extra=("mode",))
        assert rows(kw.best_matches(index, plan, 5, allowed)) == rows(want)


def test_pairs_are_summed_where_they_lie(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red")], "id long, text string")
    index = kw.save_index(kw.tokenised(docs, "id", ["text"]), str(tmp_path / "i"))
    plan = kw.match_plan(spark.createDataFrame([(7, "red fox"), (8, "fox")], "id long, t string"), "id", "t")
    found = kw.best_matches(index, plan)
    assert "hashpartitioning(query_id#0L, id#" not in (text := found._jdf.queryExecution().executedPlan().toString())
    assert not [line for line in text.splitlines() if "hashpartitioning(query_id" in line and " id#" in line.split("hashpartitioning")[1].split(")")[0]]
    assert [(r.query_id, r.id, r.mode) for r in found.orderBy("query_id", "id").collect()] == [(7, 1, "and"), (8, 1, "and")]


def test_equal_questions_are_searched_once(spark):
    found = runner("keyword_and_or_fallback")(spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "keyword-" not in plan and "plan-" not in plan  # what was found is stored and handed to all who ask
