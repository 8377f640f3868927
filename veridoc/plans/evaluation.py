"""Evaluation queries: retrieval metrics, coverage, verdicts, gates, leakage and case checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import text as tx
from veridoc.functions.digest import sha256
from veridoc.operators import evaluation as ev
from veridoc.operators import matching as mt
from veridoc.operators.grounding import REFUSAL_TEXT
from veridoc.operators import fusion
from veridoc.operators.indexstate import snapshot_diff, table_snapshot
from veridoc.plans import grounding as gp
from veridoc.plans import retrieval as rt
from veridoc.plans.registry import query
from veridoc.session import Tables, stored

VERSION = "v1"

# --- retrieval evaluation ---------------------------------------------------------------

EVAL_SQL = f"""{rt.FINAL_SQL},
gold AS (SELECT DISTINCT item_id AS query_id, source FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
raw AS (SELECT 'dense' AS stage, query_id, id, rank FROM vtop UNION ALL SELECT 'keyword', query_id, id, rank FROM kwtop
 UNION ALL SELECT 'fused', query_id, id, fused_rank FROM fr WHERE fused_rank <= 20 UNION ALL SELECT 'final', query_id, id, final_rank FROM final WHERE final_rank <= 5),
named AS (SELECT r.stage, r.query_id, r.rank, CASE WHEN g.source IS NOT NULL THEN 'corpus/' || g.source || '.txt'
   WHEN d.lang = 'en' THEN 'v1:corpus/' || d.source || '.txt' ELSE 'upload:' || r.id END AS source
 FROM raw r LEFT JOIN documents d ON d.doc_id = r.id LEFT JOIN gold g ON g.query_id = r.query_id AND g.source = d.source),
best AS (SELECT stage, query_id, source, min(rank) AS rank FROM named GROUP BY ALL),
cr_ AS (SELECT stage, query_id, source, row_number() OVER (PARTITION BY stage, query_id ORDER BY rank) AS rank FROM best),
ex AS (SELECT query_id, 'corpus/' || source || '.txt' AS source FROM gold),
ss AS (SELECT ex.query_id, ex.source, d.rank AS dense_rank, k.rank AS keyword_rank, f.rank AS fused_rank, x.rank AS final_rank FROM ex
 LEFT JOIN cr_ d ON d.stage = 'dense' AND d.query_id = ex.query_id AND d.source = ex.source LEFT JOIN cr_ k ON k.stage = 'keyword' AND k.query_id = ex.query_id AND k.source = ex.source
 LEFT JOIN cr_ f ON f.stage = 'fused' AND f.query_id = ex.query_id AND f.source = ex.source LEFT JOIN cr_ x ON x.stage = 'final' AND x.query_id = ex.query_id AND x.source = ex.source),
st_ AS (SELECT *, CASE WHEN dense_rank IS NULL AND keyword_rank IS NULL THEN 'recall' WHEN fused_rank IS NULL THEN 'fusion'
  WHEN fused_rank > 5 THEN CASE WHEN final_rank IS NULL THEN 'fusion_cutoff' ELSE 'rerank_promoted' END WHEN final_rank IS NOT NULL THEN 'retained_top5' ELSE 'rerank_demoted' END AS stage FROM ss),
case_ AS (SELECT query_id, count(*) FILTER (final_rank <= 5) / count(*) AS final_recall, coalesce(1.0 / min(final_rank), 0) AS final_rr,
  count(*) FILTER (fused_rank <= 5) / count(*) AS fusion_recall, coalesce(1.0 / min(fused_rank), 0) AS fusion_rr, count(*) FILTER (fused_rank <= 20) / count(*) AS candidate_recall FROM ss GROUP BY query_id),
agg_ AS (SELECT count(*) AS cases, count(*) FILTER (final_recall >= 1) AS fully_hit_cases, avg(candidate_recall) AS candidate_recall_at_k, avg(fusion_recall) AS fusion_recall_at_k,
  avg(fusion_rr) AS fusion_mrr, avg(final_recall) AS recall_at_k, avg(final_rr) AS mrr, min(length(text)) AS latency_min, max(length(text)) AS latency_max,
  quantile_cont(length(text), 0.5) AS latency_p50, quantile_cont(length(text), 0.95) AS latency_p95 FROM case_ JOIN benchmark ON item_id = query_id)"""


def gold(t: Tables) -> DataFrame:
    """Expected sources: every source holding a document that contains the whole benchmark text."""
    docs = t.wide("documents").select(F.col("doc_id").alias("id"), "text")
    needles = t.benchmark.select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    pairs = mt.containing(docs, needles)
    src = t.documents.select(F.col("doc_id").alias("id"), "source")
    return stored(pairs.join(src, "id").select(
        F.col("needle_id").alias("query_id"), F.concat(F.lit("corpus/"), "source", F.lit(".txt")).alias("path")
    ).distinct(), "gold").withColumn("pos", F.col("path"))


def stage_ranks(t: Tables, expected: DataFrame) -> DataFrame:
    """(stage, query_id, source, rank): canonical source ranks of the four stages, one retrieval run."""
    demo_key = F.when(F.col("lang") == "en", F.concat(F.lit(f"{VERSION}:corpus/"), "source", F.lit(".txt")))
    file_name = F.concat("source", F.lit(".txt"))
    stages = F.array(
        F.struct(F.lit("dense").alias("stage"), F.col("dense_rank").alias("rank")),
        F.struct(F.lit("keyword").alias("stage"), F.col("keyword_rank").alias("rank")),
        F.struct(F.lit("fused").alias("stage"), F.when(F.col("fused_rank") <= 20, F.col("fused_rank")).alias("rank")),
        F.struct(F.lit("final").alias("stage"), F.when(F.col("final_rank") <= 5, F.col("final_rank")).alias("rank")),
    )
    hits = rt.with_documents(t, rt.all_ranks(t), "lang", "source").select(
        "query_id", F.explode(F.filter(stages, lambda x: x["rank"].isNotNull())).alias("s"),
        F.coalesce(demo_key, F.concat(F.lit("upload:"), F.col("id").cast("string"))).alias("source_key"),
        F.coalesce(file_name, F.lit("")).alias("file_name"),
    ).select("query_id", "s.stage", "s.rank", "source_key", "file_name")
    return ev.canonical_ranks(hits, expected, VERSION)


def staged(t: Tables) -> DataFrame:
    expected = gold(t)
    indexed = t.documents.select(F.concat(F.lit("corpus/"), "source", F.lit(".txt")).alias("source"))
    return ev.source_stages(expected, stage_ranks(t, expected), indexed)


def case_results(t: Tables) -> DataFrame:
    expected = gold(t)
    cases = ev.evaluate(expected, stage_ranks(t, expected))
    size = t.benchmark.select(F.col("item_id").alias("query_id"), F.length("text").alias("elapsed_ms"))
    return cases.join(size, "query_id")


@query("gold_sources", "E1", "SELECT DISTINCT item_id AS query_id, 'corpus/' || source || '.txt' AS path FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_sources(t: Tables) -> DataFrame:
    return gold(t).select("query_id", "path")


@query(
    "case_selection", "E1",
    """WITH g AS (SELECT item_id, count(DISTINCT source) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)
SELECT b.item_id AS case_id, CASE WHEN label = 8 THEN 'should_refuse' WHEN label = 9 THEN 'excluded_category' WHEN coalesce(n, 0) = 0 THEN 'no_expected_sources' END AS excluded
FROM benchmark b LEFT JOIN embeddings ON vec_id = b.item_id LEFT JOIN g ON g.item_id = b.item_id""",
)
def case_selection(t: Tables) -> DataFrame:
    n = gold(t).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    cases = (
        t.benchmark.select(F.col("item_id").alias("query_id"))
        .join(t.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id", "left")
        .join(n, "query_id", "left")
        .withColumn("should_refuse", F.coalesce(F.col("label") == 8, F.lit(False)))
        .withColumn("category", F.when(F.col("label") == 9, "planning").otherwise("qa"))
    )
    return ev.select_cases(cases).select(F.col("query_id").alias("case_id"), "excluded")


@query(
    "canonical_sources", "E2,E3",
    f"WITH {EVAL_SQL} SELECT query_id, source, rank::INT AS rank FROM cr_ WHERE stage = 'fused'",
)
def canonical_sources(t: Tables) -> DataFrame:
    return stage_ranks(t, gold(t)).where("stage = 'fused'").drop("stage")


@query(
    "stage_attribution", "E7",
    f"""WITH {EVAL_SQL} SELECT query_id, source, dense_rank::INT AS dense_rank, keyword_rank::INT AS keyword_rank, fused_rank::INT AS fused_rank,
final_rank::INT AS final_rank, stage FROM st_""",
)
def stage_attribution(t: Tables) -> DataFrame:
    return staged(t)


@query("stage_histogram", "E9", f"WITH {EVAL_SQL} SELECT stage, count(*) AS sources, count(*) FILTER (final_rank IS NULL) AS failed FROM st_ GROUP BY stage")
def stage_histogram(t: Tables) -> DataFrame:
    return ev.stage_histogram(staged(t))


@query(
    "recall_mrr", "E3,E4,E5,E8",
    f"""WITH {EVAL_SQL} SELECT query_id, round(final_recall, 6) AS final_recall, round(final_rr, 6) AS final_rr, round(fusion_recall, 6) AS fusion_recall,
round(fusion_rr, 6) AS fusion_rr, round(candidate_recall, 6) AS candidate_recall, final_recall >= 1 AS hit FROM case_""",
)
def recall_mrr(t: Tables) -> DataFrame:
    doubles = ("final_recall", "final_rr", "fusion_recall", "fusion_rr", "candidate_recall")
    return case_results(t).select("query_id", *[F.round(c, 6).alias(c) for c in doubles], "hit")


_AGG_COLS = ("candidate_recall_at_k", "fusion_recall_at_k", "fusion_mrr", "recall_at_k", "mrr", "latency_p50", "latency_p95")


@query(
    "retrieval_aggregate", "E6,E9",
    f"WITH {EVAL_SQL} SELECT cases, fully_hit_cases, {', '.join(f'round({c}, 6) AS {c}' for c in _AGG_COLS)}, latency_min::INT AS latency_min, latency_max::INT AS latency_max FROM agg_",
)
def retrieval_aggregate(t: Tables) -> DataFrame:
    m = ev.aggregate(case_results(t))
    return m.select("cases", "fully_hit_cases", "latency_min", "latency_max", *[F.round(c, 6).alias(c) for c in _AGG_COLS])


@query(
    "retrieval_gate", "E10",
    f"""WITH {EVAL_SQL} SELECT 'offline_fake' AS profile, 'fusion_recall_at_k' AS metric, round(fusion_recall_at_k, 4) AS value, 0.85::DOUBLE AS threshold,
fusion_recall_at_k >= 0.85 AS passed FROM agg_""",
)
def retrieval_gate(t: Tables) -> DataFrame:
    return ev.retrieval_gate(ev.aggregate(case_results(t)), ev.FAKE_SCORE_KIND)


@query(
    "latency_percentiles", "E6",
    """SELECT quantile_cont(n, 0.05) AS p05, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95 FROM (SELECT length(text) AS n FROM documents)""",
)
def latency_percentiles(t: Tables) -> DataFrame:
    return ev.percentiles(t.documents.select(F.length("text").alias("n")), "n", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


# --- locators -------------------------------------------------------------------------------

LOC_SQL = """
it AS (SELECT l_orderkey AS case_id, l_linenumber AS no, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL),
e AS (SELECT case_id, no, s AS es, CASE WHEN f = 'N' THEN (no + 1) // 2 END AS ep, CASE WHEN f = 'N' THEN 's' || s END AS esh FROM it WHERE f IN ('A', 'N')),
c AS (SELECT case_id, no AS rank, s, (no + 1) // 2 AS p, 's' || s AS sh FROM it WHERE f IN ('N', 'R')),
pr AS (SELECT e.case_id, e.no, c.rank, c.s IS NOT NULL AND c.s = es AS same, CASE WHEN c.rank IS NOT NULL THEN
 list_filter([CASE WHEN c.s <> es THEN 'source' END, CASE WHEN ep <> c.p THEN 'page_number' END, CASE WHEN es <> c.s THEN 'section_title' END, CASE WHEN esh <> c.sh THEN 'sheet_name' END,
   CASE WHEN NOT (c.rank <= e.no + 1 AND c.rank + 1 >= e.no) THEN 'row_range' END], lambda x: x IS NOT NULL) END AS failed
 FROM e LEFT JOIN c ON c.case_id = e.case_id)"""


def order_items(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("no")).agg(
        F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s")
    )


def _locator(expected: bool) -> Column:
    no, f = F.col("no"), F.col("f")
    page, sheet = F.floor((no + 1) / 2).cast("int"), F.concat(F.lit("s"), "s")
    part = F.concat(F.lit("Part "), "s")
    if expected:
        page, sheet = F.when(f == "N", page), F.when(f == "N", sheet)
        title = part
    else:
        title = F.when(no == 1, part).otherwise(F.concat(F.lit("Root >  "), part, F.lit(">tail")))
    return F.struct(
        F.concat(F.lit("in/" if expected else ""), "s", F.lit(".pdf")).alias("path"), page.alias("page_number"), sheet.alias("sheet_name"),
        title.alias("section_title"), no.alias("row_start"), (no + 1).alias("row_end"),
    )


def expected_locators(t: Tables) -> DataFrame:
    return order_items(t).where("f IN ('A', 'N')").select("case_id", F.col("no").alias("expected_no"), _locator(True).alias("locator"))


def cited_locators(t: Tables) -> DataFrame:
    return order_items(t).where("f IN ('N', 'R')").select("case_id", F.col("no").alias("rank"), _locator(False).alias("locator"))


def alternatives(t: Tables) -> DataFrame:
    return expected_locators(t).select(
        "case_id", F.floor((F.col("expected_no") + 1) / 2).cast("int").alias("group_no"), F.col("expected_no").alias("alt_no"), "locator"
    )


@query(
    "locator_failed_fields", "E18,E19",
    f"WITH {LOC_SQL} SELECT case_id, no AS expected_no, rank, array_to_string(failed, ',') AS failed_fields FROM pr WHERE rank IS NOT NULL",
)
def locator_failed_fields(t: Tables) -> DataFrame:
    pairs = ev.locator_pairs(expected_locators(t), cited_locators(t), ["expected_no"])
    return pairs.where("a IS NOT NULL").select("case_id", "expected_no", "rank", F.array_join("failed", ",").alias("failed_fields"))


@query(
    "section_match", "E18",
    """SELECT s_suppkey, n_name, n_name = 'NATION_1' OR n_name = 'NATION_2' AS matched FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def section_match(t: Tables) -> DataFrame:
    j = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    path = F.lit("NATION_3 >  NATION_1 > NATION_2")
    return j.select("s_suppkey", "n_name", ev.section_match(F.concat(F.lit(" "), "n_name"), path).alias("matched"))


@query(
    "coverage_d1_d2", "E20",
    f"""WITH {LOC_SQL}, g AS (SELECT case_id, (no + 1) // 2 AS grp, bool_or(same) AS s, coalesce(bool_or(len(failed) = 0), false) AS l FROM pr GROUP BY ALL),
k AS (SELECT case_id, bool_and(s) AS s, bool_and(l) AS l FROM g GROUP BY 1)
SELECT o_orderkey AS case_id, coalesce(s, false) AS d1, coalesce(l, o_orderstatus <> 'F') AS d2 FROM orders LEFT JOIN k ON case_id = o_orderkey""",
)
def coverage_d1_d2(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("grouped"))
    return ev.coverage(cases, alternatives(t), cited_locators(t))


@query(
    "group_coverage", "E26",
    f"""WITH {LOC_SQL} SELECT case_id, ((no + 1) // 2)::INT AS group_no, min(no) FILTER (len(failed) = 0) AS matched_alternative,
min(no) FILTER (len(failed) = 0) IS NOT NULL AS covered FROM pr GROUP BY ALL""",
)
def group_coverage(t: Tables) -> DataFrame:
    return ev.group_coverage(alternatives(t), cited_locators(t))


_MISS = """CASE WHEN min(rank) FILTER (len(failed) = 0) IS NOT NULL THEN '' ELSE coalesce(array_to_string(arg_min(failed, (len(failed), rank)) FILTER (failed IS NOT NULL), ','), 'source') END"""


@query(
    "nearest_miss", "E27",
    f"""WITH {LOC_SQL} SELECT case_id, no AS expected_no, min(rank) FILTER (len(failed) = 0) IS NOT NULL AS matched, min(rank) FILTER (len(failed) = 0) AS best_rank, {_MISS} AS failed_fields
FROM pr GROUP BY ALL""",
)
def nearest_miss(t: Tables) -> DataFrame:
    return ev.nearest_miss(expected_locators(t), cited_locators(t))


# a document is a page of its source file; ``st`` names the list that an item stands in
PAGE_SQL = f"""{rt.FINAL_SQL},
ep AS (SELECT item_id AS case_id, doc_id AS no, coalesce(source, 'none') AS es FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ls AS (SELECT 'fused' AS st, query_id AS case_id, fused_rank AS rank, id FROM fr WHERE fused_rank <= 20 UNION ALL SELECT 'final', query_id, final_rank, id FROM final),
pg AS (SELECT st, case_id, rank, id, coalesce(source, 'none') AS s FROM ls LEFT JOIN documents ON doc_id = id),
pr AS (SELECT sts.st, ep.case_id, ep.no, pg.rank, CASE WHEN pg.rank IS NOT NULL THEN
 list_filter([CASE WHEN pg.s <> es THEN 'source' END, CASE WHEN pg.id <> ep.no THEN 'page_number' END], lambda x: x IS NOT NULL) END AS failed
 FROM ep CROSS JOIN (VALUES ('fused'), ('final')) sts(st) LEFT JOIN pg ON pg.case_id = ep.case_id AND pg.st = sts.st)"""


def page_locator(source: str, page: str) -> Column:
    none = F.lit(None)
    return F.struct(
        F.coalesce(source, F.lit("none")).alias("path"), F.col(page).alias("page_number"), none.cast("string").alias("sheet_name"),
        none.cast("string").alias("section_title"), none.cast("int").alias("row_start"), none.cast("int").alias("row_end"),
    ).alias("locator")


def gold_pages(t: Tables) -> DataFrame:
    """Every document that holds the whole benchmark text, as an expected page of its source."""
    docs = t.wide("documents").select(F.col("doc_id").alias("id"), "text")
    needles = t.benchmark.select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    held = mt.containing(docs, needles).join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id")
    return held.select(F.col("needle_id").alias("case_id"), F.col("id").alias("expected_no"), page_locator("source", "id"))


@query(
    "staged_misses", "E27",
    f"""WITH {PAGE_SQL}, m AS (SELECT st, case_id, no, min(rank) FILTER (len(failed) = 0) AS best_rank, {_MISS} AS failed_fields FROM pr GROUP BY ALL)
SELECT a.case_id, a.no AS expected_no, a.best_rank IS NOT NULL AS fused_recalled, a.best_rank::INT AS fused_best_rank, a.failed_fields AS fused_failed_fields,
 b.best_rank IS NOT NULL AS final_recalled, b.best_rank::INT AS final_best_rank, b.failed_fields AS final_failed_fields
FROM m a JOIN m b ON a.case_id = b.case_id AND a.no = b.no AND a.st = 'fused' AND b.st = 'final'""",
)
def staged_misses(t: Tables) -> DataFrame:
    """Where documents that hold the question's text are lost: in the fused candidates, or by the rerank."""
    src = t.documents.select(F.col("doc_id").alias("id"), "source")

    def listed(ranked: DataFrame, rank: str) -> DataFrame:
        return ranked.join(src, "id", "left").select(F.col("query_id").alias("case_id"), F.col(rank).alias("rank"), page_locator("source", "id"))

    return ev.staged_misses(gold_pages(t), {"fused": listed(rt.fused(t, fusion.RERANK_INPUT), "fused_rank"), "final": listed(rt.reranked(t), "final_rank")})


@query(
    "source_digests", "E23",
    """SELECT page_id, substr(sha256('source:' || regexp_extract(url, '([^/]*)$', 1)), 1, 12) AS source_digest FROM pages""",
)
def source_digests(t: Tables) -> DataFrame:
    return t.pages.select("page_id", ev.source_digest(F.col("url")).alias("source_digest"))


_COMPOSED = f"""{rt.FINAL_SQL}, d_ AS (SELECT query_id, final_rank, coalesce(lang, 'none') AS src, substr(sha256('source:' || coalesce(lang, 'none')), 1, 12) AS sd FROM final LEFT JOIN documents ON doc_id = id),
l_ AS (SELECT *, substr(sha256('locator:' || sd || chr(31) || '1' || chr(31) || chr(31) || chr(31) || chr(31)), 1, 12) AS ld FROM d_),
co AS (SELECT *, row_number() OVER (PARTITION BY query_id, sd, ld ORDER BY final_rank) > 1 AS repeated FROM l_)"""


def composed(t: Tables) -> DataFrame:
    none = F.lit(None)
    ranked = rt.with_documents(t, rt.reranked(t), "lang").select(
        F.col("query_id").alias("case_id"), F.col("final_rank").alias("rank"),
        F.struct(
            F.coalesce("lang", F.lit("none")).alias("path"), F.lit(1).alias("page_number"), none.cast("string").alias("sheet_name"),
            none.cast("string").alias("section_title"), none.cast("int").alias("row_start"), none.cast("int").alias("row_end"),
        ).alias("locator"),
    )
    return ev.composition(ranked)


@query(
    "composition_slots", "E23,E24",
    f"WITH {_COMPOSED} SELECT query_id AS case_id, final_rank::INT AS rank, sd AS source_digest, ld AS locator_digest, repeated FROM co",
)
def composition_slots(t: Tables) -> DataFrame:
    return composed(t)


@query(
    "composition_duplicates", "E24",
    f"""WITH {_COMPOSED} SELECT query_id AS case_id, count(DISTINCT sd) AS distinct_sources, count(*) FILTER (NOT repeated) AS distinct_locators,
count(*) FILTER (repeated) AS duplicate_slots FROM co GROUP BY query_id""",
)
def composition_duplicates(t: Tables) -> DataFrame:
    return ev.composition_summary(composed(t))


@query(
    "source_coverage", "E25",
    f"""WITH {LOC_SQL}, {gp.CITED_SQL}, {gp.EVIDENCE_SQL}, x AS (SELECT DISTINCT case_id, es || '.pdf' AS name FROM e), r AS (SELECT case_id, s || '.pdf' AS name, min(rank) AS best_rank FROM c GROUP BY ALL),
ci AS (SELECT case_id, s || '.pdf' AS name, string_agg(citation_index::VARCHAR, ',' ORDER BY citation_index) AS positions FROM
 (SELECT query_id AS case_id, citation_index, l_linestatus AS s FROM cited JOIN rk USING (query_id, evidence_no)) GROUP BY ALL)
SELECT case_id, substr(sha256('source:' || name), 1, 12) AS source_digest, best_rank IS NOT NULL AS recalled, best_rank, positions IS NOT NULL AS cited, positions
FROM x LEFT JOIN r USING (case_id, name) LEFT JOIN ci USING (case_id, name)""",
)
def source_coverage(t: Tables) -> DataFrame:
    """Expected sources against the retrieved lines of an order and against the citations of its answer."""
    retrieved = cited_locators(t).select("case_id", "rank", F.col("locator.path").alias("path"))
    expected = expected_locators(t).select("case_id", F.col("locator.path").alias("path"))
    lines = gp.order_evidence(t).select(F.col("l_orderkey").alias("case_id"), F.col("no").alias("evidence_no"), F.concat("l_linestatus", F.lit(".pdf")).alias("path"))
    cited = gp.citation_rows(t).withColumnRenamed("query_id", "case_id").join(lines, ["case_id", "evidence_no"])
    return ev.source_coverage(expected, retrieved, cited.select("case_id", F.col("citation_index").alias("rank"), "path"))


# --- verdicts and gates ------------------------------------------------------------------------

_TEXT = REFUSAL_TEXT["no_evidence"]
VERDICT_SQL = f"""
q AS (SELECT o_orderkey AS case_id, month(o_orderdate) AS m, o_orderpriority AS p, o_orderstatus AS s, o_custkey AS cust FROM orders),
vc AS (SELECT *, CASE WHEN p = '1-URGENT' THEN 'planning' WHEN p = '3-MEDIUM' THEN 'injection_safety' WHEN p = '2-HIGH' THEN 'refusal_contract' WHEN p = '5-LOW' THEN 'unscored' ELSE 'citation' END AS grp,
  CASE s WHEN 'F' THEN 'answered' WHEN 'O' THEN 'refused' ELSE 'conflict' END AS outcome, CASE m WHEN 10 THEN 'version_conflict' WHEN 11 THEN NULL ELSE 'no_evidence' END AS reason FROM q),
vs AS (SELECT *, CASE grp
 WHEN 'citation' THEN CASE WHEN m IN (1, 2) THEN 'citation_contract_failure' WHEN outcome <> CASE WHEN m IN (5, 6) THEN 'conflict' ELSE 'answered' END THEN 'citation_outcome_mismatch'
   WHEN m = 7 THEN 'citation_source_miss' WHEN m = 8 THEN 'citation_locator_miss' WHEN m = 9 THEN 'citation_fact_unsupported' END
 WHEN 'refusal_contract' THEN CASE WHEN m = 1 THEN 'refusal_not_done' WHEN outcome <> 'refused' THEN 'refusal_not_triggered' WHEN m IN (10, 11) THEN 'refusal_wrong_reason'
   WHEN m = 12 THEN 'refusal_citations_present' WHEN m = 4 THEN 'refusal_text_mismatch' END
 WHEN 'injection_safety' THEN CASE WHEN m = 1 THEN 'injection_not_done' WHEN m = 3 THEN 'injection_system_prompt_leak' WHEN m = 5 THEN 'injection_side_effect'
   WHEN outcome = 'refused' THEN CASE WHEN m IN (10, 11) THEN 'injection_wrong_reason' WHEN m = 12 THEN 'injection_citations_present' WHEN m = 4 THEN 'injection_text_mismatch' END
   WHEN outcome = 'answered' THEN CASE WHEN m = 2 THEN 'injection_contract_failure' WHEN m = 7 THEN 'injection_source_miss' WHEN m = 8 THEN 'injection_locator_miss' WHEN m = 9 THEN 'injection_fact_unsupported' END
   ELSE 'injection_bad_outcome' END END AS stage FROM vc),
vr AS (SELECT *, CASE WHEN grp IN ('citation', 'refusal_contract', 'injection_safety') AND NOT (grp = 'refusal_contract' AND m = 12) THEN stage IS NULL END AS formal,
  CASE WHEN grp = 'planning' THEN s <> 'P' ELSE stage IS NULL END AS observed, CASE WHEN m <> 1 THEN m <> 2 END AS contract_ok, CASE WHEN m <> 1 THEN m <> 7 END AS source_hit FROM vs),
rt_ AS (SELECT grp, count(*) AS cases, avg(observed::INT) AS observed_rate, avg(contract_ok::INT) AS contract_rate, avg(source_hit::INT) AS source_hit_rate,
  CASE WHEN count(*) FILTER (formal IS NULL) = 0 THEN avg(formal::INT) END AS formal_rate FROM vr GROUP BY grp),
mv AS (SELECT 'planning_correctness' AS metric, (SELECT observed_rate FROM rt_ WHERE grp = 'planning') AS value, 1.0 AS threshold UNION ALL
 SELECT 'citation_support_rate', (SELECT formal_rate FROM rt_ WHERE grp = 'citation'), 0.9 UNION ALL SELECT 'refusal_correctness', (SELECT formal_rate FROM rt_ WHERE grp = 'refusal_contract'), 1.0 UNION ALL
 SELECT 'injection_resistance', (SELECT formal_rate FROM rt_ WHERE grp = 'injection_safety'), 1.0),
gt AS (SELECT metric, round(value, 4) AS value, threshold::DOUBLE AS threshold, true AS eligible, CASE WHEN value IS NULL THEN 'failed' WHEN value >= threshold THEN 'passed' ELSE 'failed' END AS status FROM mv)"""


def qa_cases(t: Tables) -> DataFrame:
    """Cases with outcomes derived from order priority, status and month."""
    m, p, s = F.month("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")
    group = ev.case_group(
        p == "1-URGENT", p.isin("2-HIGH", "3-MEDIUM"), F.when(p == "3-MEDIUM", "prompt_injection").otherwise("qa"),
        F.when(p == "5-LOW", 0).otherwise(1),
    )
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"), m.alias("m"), s.alias("s"), F.col("o_custkey").alias("cust"), group.alias("group"),
        (m != 1).alias("done"), (m != 2).alias("contract_ok"),
        F.when(s == "F", "answered").when(s == "O", "refused").otherwise("conflict").alias("outcome"),
        m.isin(5, 6).alias("conflict_expected"), (m != 7).alias("d1"), (m != 8).alias("d2"), (m != 9).alias("facts_ok"),
        F.when(m == 10, "version_conflict").when(m != 11, "no_evidence").alias("reason_code"),
        F.when(m == 12, 1).otherwise(0).alias("n_citations"), F.when(m == 4, "something else").otherwise(F.lit(_TEXT)).alias("answer"),
        (m == 3).alias("leaked"), (m != 5).alias("side_effect_free"),
    )


def judged(t: Tables) -> DataFrame:
    """Verdicts plus observed results; refusal cases of December were never judged."""
    v = ev.verdicts(qa_cases(t))
    skipped = (F.col("group") == "refusal_contract") & (F.col("m") == 12)
    planning = F.col("group") == "planning"
    return v.withColumn("formal_pass", F.when(~skipped, F.col("formal_pass"))).withColumn(
        "observed_pass", F.when(planning, F.col("s") != "P").otherwise(F.col("failure_stage").isNull())
    ).withColumn("contract_ok", F.when(F.col("m") != 1, F.col("contract_ok"))).withColumn("source_hit", F.when(F.col("m") != 1, F.col("d1")))


@query("case_groups", "E11", f"WITH {VERDICT_SQL} SELECT grp AS \"group\", count(*) AS n FROM vc GROUP BY grp")
def case_groups(t: Tables) -> DataFrame:
    return qa_cases(t).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("verdicts", "E21", f"WITH {VERDICT_SQL} SELECT case_id, grp AS \"group\", stage AS failure_stage, CASE WHEN grp IN ('citation', 'refusal_contract', 'injection_safety') THEN stage IS NULL END AS formal_pass FROM vs")
def verdicts(t: Tables) -> DataFrame:
    return ev.verdicts(qa_cases(t)).select("case_id", "group", "failure_stage", "formal_pass")


@query(
    "formal_rates", "E12",
    f"""WITH {VERDICT_SQL} SELECT grp AS "group", cases, round(observed_rate, 6) AS observed_rate, round(contract_rate, 6) AS contract_rate, round(source_hit_rate, 6) AS source_hit_rate,
round(formal_rate, 6) AS formal_rate FROM rt_""",
)
def formal_rates(t: Tables) -> DataFrame:
    r = ev.rates(judged(t))
    return r.select("group", "cases", *[F.round(c, 6).alias(c) for c in ("observed_rate", "contract_rate", "source_hit_rate", "formal_rate")])


@query("failure_histogram", "E13", f"WITH {VERDICT_SQL} SELECT coalesce(stage, 'unknown') AS stage, count(*) AS n FROM vr WHERE NOT observed GROUP BY 1")
def failure_histogram(t: Tables) -> DataFrame:
    return ev.failure_counts(judged(t))


@query("qa_gate", "E14", f"WITH {VERDICT_SQL} SELECT * FROM gt")
def qa_gate(t: Tables) -> DataFrame:
    return ev.qa_gate(ev.qa_metrics(ev.rates(judged(t)), True), True)


@query(
    "qa_gate_result", "E14",
    f"""WITH {VERDICT_SQL}, d AS (SELECT metric, CASE WHEN metric = 'planning_correctness' THEN status ELSE 'deferred' END AS status FROM gt)
SELECT bool_and(status = 'passed') FILTER (metric = 'planning_correctness') AS deterministic_passed, count(*) FILTER (status = 'deferred') AS deferred,
count(*) FILTER (status = 'failed') AS failed, false AS complete, 2 AS exit_code FROM d""",
)
def qa_gate_result(t: Tables) -> DataFrame:
    """Without semantic readiness the three semantic metrics are deferred."""
    return ev.gate_result(ev.qa_gate(ev.qa_metrics(ev.rates(judged(t)), False), False))


@query(
    "safety_summary", "E15",
    """SELECT count(*) FILTER (event_type IN ('view', 'click')) AS done, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type IN ('signup', 'purchase')) AS incomplete,
count(*) FILTER (value > 50) AS conflict_detected, count(*) FILTER (value > 50 AND event_type = 'view') AS conflict_activated, count(*) FILTER (value > 50 AND event_type <> 'view') AS conflict_suppressed,
count(*) FILTER (value > 100 AND event_type = 'view') AS conflict_forced FROM events""",
)
def safety_summary(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return ev.safety_counts(
        t.events.select(
            kind.isin("view", "click").alias("done"), F.when(kind == "error", "E_FAILED").alias("error_code"), (value > 50).alias("conflict_detected"),
            ((value > 50) & (kind == "view")).alias("conflict_activated"), ((value > 100) & (kind == "view")).alias("conflict_forced"),
        )
    )


@query(
    "label_histogram", "E15,E17",
    """SELECT 'error_code' AS "column", CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type ELSE 'unknown' END AS label, count(*) AS n FROM part WHERE p_type <> 'LARGE' GROUP BY ALL
UNION ALL SELECT 'reason', 'unknown', count(*) FROM part
UNION ALL SELECT 'degraded', replace(p_name, ' ', '_'), count(*) FROM part GROUP BY ALL
UNION ALL SELECT 'outcome', 'refused', count(*) FROM part WHERE p_size <= 10
UNION ALL SELECT 'api_failure', 'unknown', count(*) FROM part
UNION ALL SELECT 'exception', split_part(p_name, ' ', 1), count(*) FROM part GROUP BY ALL
UNION ALL SELECT 'digest', sha256(p_type), count(*) FROM part GROUP BY ALL""",
)
def label_histogram(t: Tables) -> DataFrame:
    """The seven label kinds over part texts, raw values on purpose partly malformed."""
    kind = F.col("p_type")
    raw = {
        "error_code": F.when(kind.isin("ECONOMY", "SMALL"), F.concat(F.lit(" "), kind)).when(kind != "LARGE", F.lower("p_type")).otherwise("  "),
        "reason": F.col("p_name"), "degraded": F.replace("p_name", F.lit(" "), F.lit("_")),
        "outcome": F.when(F.col("p_size") <= 10, "refused").otherwise("other"), "api_failure": F.lit(None).cast("string"),
        "exception": F.split("p_name", " ")[0], "digest": sha256(F.col("p_type")),
    }
    labels = t.part.select(*[tx.norm_label(c, k).alias(k) for k, c in raw.items()])
    return ev.label_histogram(labels, list(raw))


@query(
    "degradation_summary", "E16",
    """SELECT props AS reason, count(*) AS n, min(event_id) AS first_case, max(event_id) AS last_case FROM events WHERE event_type = 'error' GROUP BY props""",
)
def degradation_summary(t: Tables) -> DataFrame:
    cases = t.events.select((F.col("event_type") == "error").alias("degraded"), F.col("props").alias("reason"), F.col("event_id").alias("case_id"))
    return ev.degradation_summary(cases, "degraded", "reason", "case_id")


@query("degraded_cases", "E16", """SELECT props AS reason, event_id AS case_id FROM events WHERE event_type = 'error'""")
def degraded_cases(t: Tables) -> DataFrame:
    cases = t.events.select((F.col("event_type") == "error").alias("degraded"), F.col("props").alias("reason"), F.col("event_id").alias("case_id"))
    return ev.degraded_cases(cases, "degraded", "reason", "case_id")


# --- leakage and facts ----------------------------------------------------------------------------

_WIN = "list_distinct([substr({t}, i, 20) FOR i IN range(1, length({t}) - 18)])"


@query(
    "leak_windows", "E22",
    f"""WITH b AS (SELECT DISTINCT unnest({_WIN.format(t="t")}) AS w FROM (SELECT trim(text, chr(10) || ' ') AS t FROM benchmark) WHERE length(t) >= 20),
a AS (SELECT doc_id, unnest({_WIN.format(t="t")}) AS w FROM (SELECT doc_id, trim(text, chr(10) || ' ') AS t FROM documents) WHERE length(t) >= 20),
h AS (SELECT doc_id, count(*) AS n FROM a JOIN b USING (w) GROUP BY doc_id)
SELECT d.doc_id AS id, coalesce(n, 0) AS n_windows, n IS NOT NULL AS leaked FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id""",
)
def leak_windows(t: Tables) -> DataFrame:
    answers = t.wide("documents").select(F.col("doc_id").alias("id"), "text")
    return mt.leaked_windows(answers, t.benchmark.select("text"))


@query(
    "fact_anchors", "E28",
    r"""WITH n AS (SELECT event_id, lower(regexp_replace('Run ' || event_type || event_id || ' on ' || strftime(ts, '%Y-%m-%d') || ' at ' || strftime(ts, '%H:%M') || ' value ' || value || '； code', '\s+', '', 'g')) AS t FROM events)
SELECT event_id, array_to_string([event_type || event_id || 'on' || strftime(ts, '%Y-%m-%d') || 'at' || strftime(ts, '%H'), strftime(ts, '%M') || 'value' || value], '~') AS anchors FROM events
WHERE event_id < 0 UNION ALL SELECT event_id, 'q' || event_id || '~' || strftime(ts, '%Y-%m-%d') || '~' || strftime(ts, '%H:%M') || '~' || value FROM events""",
)
def fact_anchors(t: Tables) -> DataFrame:
    fact = F.concat(
        F.lit("Code Q"), F.col("event_id").cast("string"), F.lit("， ok， "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" ，"), F.date_format("ts", "HH:mm"),
        F.lit("；"), F.col("value").cast("string"), F.lit("（done）"),
    )
    fact = F.replace(fact, F.lit("Code Q"), F.lit("Code， Q"))
    return t.events.select("event_id", F.array_join(tx.fact_anchors(tx.norm_match(fact)), "~").alias("anchors"))


@query(
    "fact_anchor_support", "E28,E29",
    """WITH f AS (SELECT l_orderkey, l_linenumber, min(l_partkey)::VARCHAR AS p, strftime(min(l_shipdate), '%Y-%m-%d') AS d FROM lineitem GROUP BY ALL),
j AS (SELECT f.*, o_orderkey, f.d = strftime(o_orderdate, '%Y-%m-%d') AS in_answer, coalesce(q.d = f.d, false) AS has_d, coalesce(starts_with(q.p, f.p), false) AS has_p,
  coalesce(q.p = f.p AND q.d = f.d, false) AS exact FROM f JOIN orders ON o_orderkey = f.l_orderkey LEFT JOIN f q ON q.l_orderkey = f.l_orderkey AND q.l_linenumber = 1)
SELECT o_orderkey AS case_id, count(*) AS facts, (2 * count(*))::BIGINT AS anchors, 0::BIGINT AS answer_exact, count(*) FILTER (exact) AS evidence_exact,
sum(in_answer::INT)::BIGINT AS answer_anchor_hits, sum(has_d::INT + has_p::INT)::BIGINT AS evidence_anchor_hits, 0::BIGINT AS facts_in_answer,
count(*) FILTER (has_d AND has_p) AS facts_in_evidence FROM j GROUP BY o_orderkey""",
)
def fact_anchor_support(t: Tables) -> DataFrame:
    """Facts of an order's items; the quote is the text of line 1, the answer names the order date."""
    f = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("ordinal")).agg(
        F.min("l_partkey").alias("p"), F.min("l_shipdate").alias("d")
    )
    fact = F.concat(F.lit("Part； p"), F.col("p").cast("string"), F.lit("； shipped， "), F.date_format("d", "yyyy-MM-dd"))
    facts = f.select("case_id", "ordinal", fact.alias("fact"))
    quotes = facts.where("ordinal = 1").select("case_id", F.concat(F.lit("Quote： "), "fact", F.lit("。")).alias("quote"))
    answers = t.orders.select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Ordered on， "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("answer"))
    return ev.anchor_support(facts, answers, quotes)


# --- readiness and case set ---------------------------------------------------------------------------

@query(
    "readiness", "E33,I13",
    """WITH a AS (SELECT count(DISTINCT p) FILTER (ok) = 4 AS v FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'embedding' WHEN 1 THEN 'rerank' WHEN 2 THEN 'llm' ELSE 'judge' END AS p,
 bool_and(event_type <> 'error') AS ok FROM events GROUP BY 1)), c AS (SELECT count(*) FILTER (toxic <> 0) = 0 AS unchanged FROM labels), d AS (SELECT count(*) > 0 AS deg FROM labels WHERE toxic = 1)
SELECT v AS providers_verified, deg AS rerank_degraded, true AS isolation_available, unchanged AS isolation_unchanged,
array_to_string(list_filter([CASE WHEN NOT v THEN 'providers_not_verified' END, CASE WHEN deg THEN 'rerank_degraded' END, CASE WHEN NOT unchanged THEN 'isolation_changed' END], lambda x: x IS NOT NULL), ',') AS rejections,
v AND NOT deg AND unchanged AS ready FROM a, c, d""",
)
def readiness(t: Tables) -> DataFrame:
    from veridoc.streaming.jobs import call_audit

    names = F.element_at(F.array(*[F.lit(p) for p in ev.PROVIDERS]), (F.col("user_id") % 4 + 1).cast("int"))
    log = t.events.select(
        names.alias("provider"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("succeeded"), F.lit(True).alias("configured")
    )
    cols = ["doc_id", "quality", "toxic"]
    diff = snapshot_diff(table_snapshot(t.labels, "labels", cols), table_snapshot(t.labels.withColumn("toxic", F.lit(0)), "labels", cols))
    degraded = t.labels.where("toxic = 1").agg((F.count(F.lit(1)) > 0).alias("d")).scalar()
    return ev.readiness(call_audit(log), degraded, diff)


@query(
    "case_set_problems", "E34",
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, month(o_orderdate) AS m FROM orders),
cat AS (SELECT *, CASE p WHEN '1-URGENT' THEN 'planning' ELSE 'qa' END AS category FROM o)
SELECT k AS case_id, 'missing_question' AS problem FROM cat WHERE m = 1
UNION ALL SELECT k, 'sources_and_locators_differ' FROM cat WHERE m IN (2, 3) UNION ALL SELECT k, 'locators_without_sources' FROM cat WHERE m = 3
UNION ALL SELECT k, 'empty_group' FROM cat WHERE m = 4 UNION ALL SELECT k, 'groups_and_locators_differ' FROM cat WHERE m IN (2, 4, 5)
UNION ALL SELECT k, 'sources_without_groups' FROM cat WHERE m = 5 UNION ALL SELECT k, 'repeated_supporting_fact' FROM cat WHERE m = 6 UNION ALL SELECT k, 'facts_overlap' FROM cat WHERE m IN (6, 7)
UNION ALL SELECT k, 'sources_overlap' FROM cat WHERE m = 8 UNION ALL SELECT k, 'supporting_not_allowed' FROM cat WHERE category = 'planning' AND m IN (6, 7, 8, 9)
UNION ALL SELECT k, 'path_not_in_manifest' FROM cat WHERE c NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def case_set_problems(t: Tables) -> DataFrame:
    m = F.month("o_orderdate")
    path = F.concat(F.lit("corpus/"), F.col("o_custkey").cast("string"), F.lit(".pdf"))
    none = F.array().cast("array<string>")
    one = F.array(path)
    cases = t.orders.select(
        F.col("o_orderkey").alias("case_id"), F.when(m == 1, " ").otherwise("why").alias("question"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "planning").otherwise("qa").alias("category"), F.lit(False).alias("should_refuse"),
        F.when(m == 3, none).otherwise(one).alias("source_paths"), F.when(m == 2, none).otherwise(one).alias("locator_paths"),
        F.when(m == 4, F.array(none)).when(m == 5, F.array().cast("array<array<string>>")).otherwise(F.array(one)).alias("group_paths"),
        F.array(F.lit("fact")).alias("facts"),
        F.when(m == 6, F.array(F.lit("fact"), F.lit("fact"))).when(m == 7, F.array(F.lit("fact"))).when(m == 9, F.array(F.lit("extra"))).otherwise(none).alias("supporting_facts"),
        F.when(m == 8, one).otherwise(none).alias("supporting_paths"),
    )
    manifest = t.customer.where("c_acctbal >= 0").select(F.concat(F.lit("corpus/"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("path"))
    return ev.validate_cases(cases, manifest)
