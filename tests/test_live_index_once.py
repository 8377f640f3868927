"""A live index reads its texts once and moves only postings that have to meet."""

from pyspark.sql import functions as F

from veridoc.operators import keyword as kw


def test_rows_are_tokenised_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    docs = spark.createDataFrame([(1, "red fox red"), (2, "red"), (None, "blue")], "id long, text string").coalesce(1)
    tokens = kw.tokenised(docs.select("id", seen("text").alias("text")), "id", ["text"], cjk=False)
    calls.value = 0
    store = f"{spark.conf.get('spark.checkpoint.dir', '/tmp')}/live-{id(tokens)}"
    index = kw.create_live_index(tokens, store, 4)
    assert calls.value == 3
    assert sorted(map(tuple, index.postings.select("term", "id", "tf").collect()), key=str) == sorted([("red", 1, 2), ("fox", 1, 1), ("red", 2, 1), ("blue", None, 1)], key=str)


def test_postings_of_ids_that_do_not_repeat_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red")], "id long, text string")
    postings, lengths = kw._counted_once(kw.tokenised(docs, "id", ["text"]))
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    again = docs.unionByName(spark.createDataFrame([(1, "fox")], docs.schema))
    merged, lengths = kw._counted_once(kw.tokenised(again, "id", ["text"]))
    assert sorted((r.term, r.id, r.tf) for r in merged.collect()) == [("fox", 1, 2), ("red", 1, 2), ("red", 2, 1)]
    assert sorted(map(tuple, lengths.collect())) == [(1, 1), (1, 3), (2, 1)]
