"""Retrieval over eligible rows: statistics of the whole index, ranks among what may be returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.operators import fusion
from veridoc.plans import index as ix
from veridoc.plans import retrieval as rt
from veridoc.plans.registry import query
from veridoc.session import Tables

_ALLOWED = "(SELECT doc_id FROM elig)"
_KEYWORD = rt.KEYWORD_SQL.replace("FROM qm JOIN w USING (term) GROUP BY", f"FROM qm JOIN w USING (term) WHERE id IN {_ALLOWED} GROUP BY")
_VECTOR = rt.VECTOR_SQL.replace("FROM qv, vec)", f"FROM qv, vec WHERE vec.id IN {_ALLOWED})")
_FUSED = rt.FUSED_SQL.replace(rt.KEYWORD_SQL, _KEYWORD).replace(rt.VECTOR_SQL, _VECTOR)
_META = f"{ix.META_SQL}, {ix.ELIGIBLE_SQL}"


def allowed(t: Tables) -> DataFrame:
    return ix.eligible_docs(t).select(F.col("doc_id").alias("id")).distinct()


@query("keyword_eligible", "R5,R7,R10,R11", f"WITH {_META}, {_KEYWORD} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM kwtop")
def keyword_eligible(t: Tables) -> DataFrame:
    return rt.keyword_top(t, allowed(t)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_eligible", "R8,R10,R11", f"WITH {_META}, {_VECTOR} SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM vtop")
def vector_eligible(t: Tables) -> DataFrame:
    return rt.vector_top(t, allowed(t)).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "hybrid_eligible", "R8,R10,R11,R12",
    f"""WITH {_META}, {_FUSED} SELECT query_id, id, dense_rank::INT AS dense_rank, keyword_rank::INT AS keyword_rank,
round(fused_score, 9) AS fused_score, fused_rank::INT AS fused_rank FROM fr""",
)
def hybrid_eligible(t: Tables) -> DataFrame:
    ids = allowed(t)
    return fusion.rrf(rt.vector_top(t, ids), rt.keyword_top(t, ids)).select(
        "query_id", "id", "dense_rank", "keyword_rank", F.round("fused_score", 9).alias("fused_score"), "fused_rank"
    )
