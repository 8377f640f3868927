"""Rank fusion, rerank merge, degradation, context rows and answerability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.digest import hash_score
from veridoc.operators.keyword import RANK_SCALE

# --- fixed values -----------------------------------------------------------
RRF_K = 60
RERANK_INPUT = 20
RERANK_OUTPUT = 10
DEGRADED_DEFAULT = "reranker_unavailable"
METADATA_FIELDS = (
    "course_code", "doc_category", "document_version", "effective_from", "page_number",
    "sheet_name", "row_start", "row_end", "section_title",
)
# --- end of fixed values ----------------------------------------------------


def rrf(dense: DataFrame, keyword: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Fuse two ranked lists: sum of 1/(k + rank), best single rank, then id.

    Both lists hold at most top-k rows per query, so every window below is small.
    """
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    s = keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    both = d.join(s, ["query_id", "id"], "full_outer")

    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.col(rank) + F.lit(k)), F.lit(0.0))

    fused = both.select(
        "query_id", "id", "dense_rank", "keyword_rank",
        F.round(part("dense_rank") + part("keyword_rank"), 12).alias("fused_score"),
        F.least("dense_rank", "keyword_rank").alias("best_rank"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("fused_score").desc(), "best_rank", "id")
    out = fused.withColumn("fused_rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("fused_rank") <= limit)


def output_limit(requested: Column | None, configured: int, cap: int = RERANK_OUTPUT) -> Column:
    """Explicit limit first, non-positive means nothing, never above ``cap``."""
    raw = F.lit(configured) if requested is None else F.coalesce(requested, F.lit(configured))
    return F.when(raw <= 0, F.lit(0)).otherwise(F.least(raw, F.lit(cap)))


def candidate_text(text: Column, metadata: dict[str, Column]) -> Column:
    """Body plus one JSON line of the white-listed fields; empty fields are left out."""
    fields = [
        F.when(metadata[name].cast("string") != "", metadata[name]).alias(name)
        for name in METADATA_FIELDS
        if name in metadata
    ]
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.to_json(F.struct(*fields)))


def rerank_merge(
    fused: DataFrame, scores: DataFrame, top_k: int = RERANK_OUTPUT, requested: str | None = None,
    candidates: int = RERANK_INPUT, cap: int = RERANK_OUTPUT,
) -> DataFrame:
    """Order the first ``candidates`` by score, fused score, id and keep the output limit, at most ``cap``.

    A query with any missing score is degraded: fused order, null score, a stable reason.
    A score that is present but not finite makes the whole query invalid.
    """
    cand = fused.where(F.col("fused_rank") <= candidates)
    joined = cand.join(scores.select("query_id", "id", "rerank_score"), ["query_id", "id"], "left")
    q = Window.partitionBy("query_id")  # as many rows as candidates
    finite = ~F.isnan("rerank_score") & (F.abs("rerank_score") < F.lit(float("inf")))
    joined = joined.withColumn(
        "degraded", F.max(F.col("rerank_score").isNull()).over(q)
    ).withColumn(
        "invalid", F.max(F.coalesce(~finite, F.lit(False))).over(q)
    )
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("degraded"), F.lit(0.0)).otherwise(F.col("rerank_score")).desc(),
        F.when(F.col("degraded"), F.col("fused_rank")).otherwise(F.lit(0)),
        F.col("fused_score").desc(),
        "id",
    )
    limit = output_limit(F.col(requested) if requested else None, top_k)
    ranked = joined.withColumn("position", F.row_number().over(order)).withColumn("lim", limit)
    return ranked.where((F.col("position") <= F.col("lim")) & ~F.col("invalid")).select(
        "query_id", "id", "fused_rank", "fused_score",
        F.when(~F.col("degraded"), F.col("rerank_score")).alias("rerank_score"),
        F.when(~F.col("degraded"), F.col("position")).alias("rerank_rank"),
        (~F.col("degraded")).alias("rerank_applied"),
        F.when(F.col("degraded"), F.lit(DEGRADED_DEFAULT)).alias("degraded_reason"),
        F.col("position").alias("final_rank"),
    )


def with_final_rank(cand: DataFrame, score: str = "rerank_score", top_k: int = RERANK_OUTPUT) -> DataFrame:
    """All fused rows with the rank the reranked output gives them; null outside it.

    Every row of the first 20 must carry its score. One small window per query, no second
    pass over the candidates.
    """
    inside = F.col("fused_rank") <= RERANK_INPUT
    order = Window.partitionBy("query_id").orderBy(
        F.when(inside, 0).otherwise(1), F.when(inside, F.col(score)).desc(), F.col("fused_score").desc(), "id"
    )
    position = F.row_number().over(order)
    return cand.withColumn("_p", position).withColumn(
        "final_rank", F.when(inside & (F.col("_p") <= top_k), F.col("_p"))
    ).drop("_p")


def hash_scores(candidates: DataFrame, query_text: str, text: str) -> DataFrame:
    return candidates.select(
        "query_id", "id", hash_score(F.col(query_text), F.col(text)).alias("rerank_score")
    )


def score_with(candidates: DataFrame, query_text: str, text: str, scorer, limit: int = RERANK_INPUT) -> DataFrame:
    """Run a user's scorer ``(query, list[str]) -> list[float]`` per query on its first ``limit`` candidates."""

    def run(pdf):
        values = list(scorer(pdf["q"].iloc[0], pdf["t"].tolist()))
        if len(values) != len(pdf):
            raise ValueError("score_count_mismatch")
        return pdf[["query_id", "id"]].assign(rerank_score=[float(v) for v in values])

    src = candidates.where(F.col("fused_rank") <= limit).select(
        "query_id", "id", F.col(query_text).alias("q"), F.col(text).alias("t")
    )
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.groupBy("query_id").applyInPandas(
        run, f"query_id {types['query_id']}, id {types['id']}, rerank_score double"
    )


def source_labels(ranked: DataFrame, doc_col: str, rank_col: str = "final_rank") -> DataFrame:
    """S1, S2, ... per document in order of first appearance; at most 20 rows per query."""
    per_doc = Window.partitionBy("query_id", doc_col)
    first = ranked.withColumn("_first", F.min(rank_col).over(per_doc))
    label = F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))
    return first.withColumn("label", F.concat(F.lit("S"), label.cast("string"))).drop("_first")


def answerability(queries: DataFrame, ranked: DataFrame, threshold: float | None) -> DataFrame:
    """Reason why a query is not answered before generation; null when it can be answered."""
    agg = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("rerank_score").alias("best"),
        F.max(F.col("rerank_score").isNull()).alias("any_null"),
    )
    out = queries.select("query_id").join(agg, "query_id", "left")
    reason = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.lit("no_evidence"))
    if threshold is not None:
        reason = reason.when(F.col("any_null"), F.lit("score_unavailable")).when(
            F.col("best") < threshold, F.lit("below_score_threshold")
        )
    return out.select(
        "query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_evidence"),
        F.round("best", RANK_SCALE).alias("best_score"), reason.alias("reason"),
    )
