"""Best k rows of a keyword batch without scoring every match.

A posting's impact is its weight without the word's idf. Postings are stored by word and impact level, so that a block
(word, level) has one greatest impact; the best few postings of every word are stored once more as its head.

1. The rows that the heads put first are scored exactly: the k-th best of them bounds the k-th best score from below.
2. A query's words are ordered by the most they can add. Those whose sum stays below the bound cannot lift a row into the
   first k alone; rows are looked for among the postings of the other words only, and there only in blocks whose greatest
   impact, with the most that all other words can add, reaches the bound.
3. What was found, plus the most that the passed-over words can add, is held against the bound once more. Only the rows left
   are scored exactly, over all words of the query, by looking their postings up.

Ranks are those of scoring everything: bounds are lowered by more than scores are rounded by. Weights are positive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.operators import keyword as kw

LEVELS = 64  # impact levels between zero and the greatest possible impact, K1 + 1
HEAD = 64  # postings of a word's head
TRIED = 4  # rows scored for the bound, in multiples of k
REACH = 0.25  # the words passed over may add at most this part of the bound
SLACK = 1e-7  # scores are rounded at nine decimals


@dataclass(frozen=True)
class BoundedIndex:
    """postings (term, level, id, impact), blocks (term, level, n, best), heads (term, id, impact), terms (term, idf, best)."""

    postings: DataFrame
    blocks: DataFrame
    heads: DataFrame
    terms: DataFrame


def save_bounds(index: kw.Index, path: str) -> BoundedIndex:
    """Store a keyword index by impact. Heads are cut in the map tasks, so a frequent word sends few rows."""
    spark = index.postings.sparkSession
    totals = index.totals.select(F.struct("n", "avgdl").alias("s")).scalar()
    n, avgdl = totals["n"], totals["avgdl"]
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    impact = tf * (kw.K1 + 1) / (tf + kw.K1 * (1 - kw.B + kw.B * dl / avgdl))
    level = F.floor(F.col("impact") * (LEVELS / (kw.K1 + 1))).cast("int")
    ranked = index.postings.select("term", "id", impact.alias("impact")).withColumn("level", level)
    ranked.repartition("term", "level").sortWithinPartitions("term", F.desc("level")).write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("best")).write.parquet(f"{path}/blocks")
    best_first = Window.partitionBy("term").orderBy(F.desc("impact"), "id")
    postings.select("term", "id", "impact", F.row_number().over(best_first).alias("r")).where(F.col("r") <= HEAD).drop("r") \
        .repartition("term").sortWithinPartitions("term").write.parquet(f"{path}/heads")
    best = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.max("best").alias("best"))
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(kw.IDF_FLOOR))
    index.terms.select("term", idf.alias("idf")).join(best, "term").write.parquet(f"{path}/terms")
    return load_bounds(spark, path)


def load_bounds(spark: SparkSession, path: str) -> BoundedIndex:
    return BoundedIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "blocks", "heads", "terms")))


def _query_terms(index: BoundedIndex, query_tokens: DataFrame) -> DataFrame:
    """(query_id, term, factor, most): repeats times idf, and the most the word can add to a score."""
    q = query_tokens.groupBy("query_id", F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("mult"))
    return q.join(index.terms, "term").select(
        "query_id", "term", (F.col("mult") * F.col("idf")).alias("factor"), (F.col("mult") * F.col("idf") * F.col("best")).alias("most")
    )


def _restricted(postings: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return postings if allowed is None else postings.join(allowed.select("id").distinct(), "id", "left_semi")


def _looked_up(index: BoundedIndex, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, factor, impact): the postings of the words of a query in given rows (query_id, id)."""
    asked = rows.join(terms.select("query_id", "term", "factor"), "query_id")
    return asked.join(index.postings.select("term", "id", "impact"), ["term", "id"]).select("query_id", "id", "factor", "impact")


def _best(sums: DataFrame, rows: int) -> DataFrame:
    best_first = Window.partitionBy("query_id").orderBy(F.desc("s"))
    return sums.withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= rows).drop("r")


def _sum() -> Column:
    return F.sum(F.col("factor") * F.col("impact")).alias("s")


def _thresholds(index: BoundedIndex, terms: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """(query_id, threshold) for queries with k rows in the heads of their words; others have no bound.

    The ``TRIED`` * k rows that the heads put first are scored exactly; the k-th best of them is the bound.
    """
    partial = _restricted(index.heads, allowed).join(terms, "term").groupBy("query_id", "id").agg(_sum())
    exact = _looked_up(index, _best(partial, TRIED * k).select("query_id", "id"), terms).groupBy("query_id", "id").agg(_sum())
    return _best(exact, k).groupBy("query_id").agg((F.min("s") - SLACK).alias("threshold"), F.count(F.lit(1)).alias("held")) \
        .where(F.col("held") == k).drop("held")


def search_plan(index: BoundedIndex, query_tokens: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, term, factor, most, threshold, passed_over, others): what each word of a query is good for.

    ``passed_over`` is what the words not searched can add together, ``others`` what all other words can add. The window
    runs over the words of one query.
    """
    terms = _query_terms(index, query_tokens)
    bound = terms.join(_thresholds(index, terms, k, allowed), "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    rising = Window.partitionBy("query_id").orderBy("most", "term")
    whole = Window.partitionBy("query_id")
    summed = bound.withColumn("_sum", F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    searched = summed.withColumn("searched", F.col("_sum") >= REACH * F.col("threshold"))
    return searched.select(
        "query_id", "term", "factor", "most", "threshold", "searched",
        F.coalesce(F.max(F.when(~F.col("searched"), F.col("_sum"))).over(whole), F.lit(0.0)).alias("passed_over"),
        (F.sum("most").over(whole) - F.col("most")).alias("others"),
    )


def live_blocks(index: BoundedIndex, plan: DataFrame) -> DataFrame:
    """(query_id, term, level, n, factor, threshold, passed_over): blocks that may hold a row of the first k."""
    return plan.where("searched").join(index.blocks, "term").where(
        F.col("factor") * F.col("best") + F.col("others") + SLACK >= F.col("threshold")
    ).select("query_id", "term", "level", "n", "factor", "threshold", "passed_over")


def _candidates(index: BoundedIndex, plan: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(query_id, id): rows that may be among the first k.

    A row with a posting in a block left out is below the bound whatever else it holds, so its sum here may be too small.
    """
    hits = live_blocks(index, plan).drop("n").join(_restricted(index.postings, allowed), ["term", "level"])
    found = hits.groupBy("query_id", "id").agg(
        F.sum(F.col("factor") * F.col("impact")).alias("s"), F.first("threshold").alias("threshold"), F.first("passed_over").alias("passed_over")
    )
    return found.where(F.col("s") + F.col("passed_over") + SLACK >= F.col("threshold")).select("query_id", "id")


def bm25_top_k(index: BoundedIndex, query_tokens: DataFrame, k: int = kw.KEYWORD_TOP_K, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the same rows as ``keyword.top_k(keyword.bm25_scores(...))``.

    ``query_tokens`` is (query_id, token), repeats count; ``allowed`` (id) restricts what may be returned.
    """
    plan = search_plan(index, query_tokens, k, allowed)
    scores = _looked_up(index, _candidates(index, plan, allowed), plan).groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("factor") * F.col("impact")), kw.RANK_SCALE).alias("score")
    )
    return kw.top_k(scores, k)


def share_scored(index: BoundedIndex, query_tokens: DataFrame, k: int = kw.KEYWORD_TOP_K, allowed: DataFrame | None = None) -> DataFrame:
    """One row: postings that match the batch, those in live blocks, those looked up for the rows left, and the share of both."""
    plan = search_plan(index, query_tokens, k, allowed)
    matched = plan.join(index.blocks, "term").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"))
    live = live_blocks(index, plan).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    looked = _looked_up(index, _candidates(index, plan, allowed), plan).agg(F.count(F.lit(1)).alias("n"))
    both = matched.select("matched", live.select("n").scalar().alias("searched"), looked.select("n").scalar().alias("looked_up"))
    return both.withColumn("share", (F.col("searched") + F.col("looked_up")) / F.nullif("matched", F.lit(0)))
