"""Conversation checks and audits of model and judge output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import jsonx as jx
from veridoc.functions import text as tx

# --- fixed values -----------------------------------------------------------
MAX_MESSAGES = 10
MAX_MESSAGE_CHARS = 4000
MAX_TOTAL_CHARS = 12000
ROLES = ("user", "assistant")
OUTCOMES = ("answered", "refused", "conflict")
REASON_CODES = (
    "no_evidence", "below_score_threshold", "score_unavailable", "planning_unavailable",
    "version_conflict", "insufficient_evidence",
)
REFUSAL_TEXT = {
    "no_evidence": "知识库中没有检索到与问题相关的资料，无法回答。",
    "below_score_threshold": "检索到的资料与问题的相关度过低，证据不足，无法回答。",
    "score_unavailable": "当前无法获得可比较的相关度分数，证据置信度不可用，无法回答。",
    "planning_unavailable": "该问题需要依据个人课程记录进行确定性学分计算或学业规划，学业规划规则引擎尚未接入，暂时无法回答。",
    "insufficient_evidence": "现有资料不足以支持确定的结论，无法回答。",
}
MARKER = r"\[(\d{1,3})\]"
FACT_KEYS = ("answer_expresses", "evidence_indices", "evidence_supports", "fact_index")
VERDICTS = ("supported", "partially_supported", "unsupported")
# --- end of fixed values ----------------------------------------------------


# --- conversations (G1) ----------------------------------------------------------

def check_turns(turns: DataFrame) -> DataFrame:
    """Per conversation (conv_id, turn, role, text): question and the first violation.

    Only counts, sums and the last message are aggregated, so an over-long conversation
    costs no memory; it is refused by its count.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    agg = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(size).alias("n_chars"),
        F.max(size).alias("longest"),
        F.max(~F.col("role").isin(*ROLES)).alias("bad_role"),
        F.max_by("role", "turn").alias("last_role"),
        F.max_by("text", "turn").alias("last_text"),
    )
    question = tx.strip_ws(F.coalesce("last_text", F.lit("")))
    reason = (
        F.when(F.col("n_messages") > MAX_MESSAGES, "too_many_messages")
        .when(F.col("bad_role"), "bad_role")
        .when(F.col("longest") > MAX_MESSAGE_CHARS, "message_too_long")
        .when(F.col("last_role") != "user", "last_not_user")
        .when(question == "", "empty_question")
        .when(F.col("n_chars") > MAX_TOTAL_CHARS, "conversation_too_long")
    )
    return agg.select(
        "conv_id", "n_messages", "n_chars", reason.alias("reason"), F.when(reason.isNull(), question).alias("question")
    )


def assemble_turns(turns: DataFrame) -> DataFrame:
    """Valid conversations with their history as an ordered list of at most nine messages."""
    checked = check_turns(turns).where("reason IS NULL")
    kept = turns.join(checked.select("conv_id"), "conv_id", "left_semi")
    lists = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    history = F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return checked.select("conv_id", "question").join(lists, "conv_id").select("conv_id", "question", history.alias("history"))


# --- completions (G12-G15) ---------------------------------------------------------

def strip_fence(raw: Column) -> Column:
    """One surrounding code fence, with or without a json tag, is tolerated."""
    def bare(text: Column) -> Column:
        inner = tx.strip_ws(F.regexp_replace(F.substring(text, F.lit(4), F.length(text)), r"^(?i)json", ""))
        inner = tx.strip_ws(F.regexp_replace(inner, r"```\z", ""))
        return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)

    return tx.let(tx.strip_ws(F.coalesce(raw, F.lit(""))), bare)


def _first(problems: Column) -> Column:
    return F.get(F.filter(problems, lambda p: p.isNotNull()), F.lit(0))


def _index_problem(items: Column, upper: Column, bad: str, out: str, duplicate: str) -> Column:
    """First problem of an index list in element order: wrong type, out of range or repeated."""
    return tx.let(
        F.transform(items, jx.integer),
        lambda ns: _first(
            F.transform(
                ns,
                lambda n, i: F.when(n.isNull(), F.lit(bad))
                .when((n < 1) | (n > upper), F.lit(out))
                .when(F.array_position(ns, n) < i + 1, F.lit(duplicate)),
            )
        ),
    )


def answer_markers(answer: Column) -> Column:
    return F.array_distinct(
        F.transform(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)), lambda x: x.try_cast("bigint"))
    )


def audit_completions(df: DataFrame, max_answer: int = 4000) -> DataFrame:
    """Add outcome, reason_code, answer, citations and the first contract violation.

    Input: raw, evidence_count, required_indices (array<bigint>).
    """
    upper = F.col("evidence_count")
    required = F.coalesce("required_indices", F.array().cast("array<bigint>"))

    def read(v: Column) -> Column:
        items = F.try_variant_get(v, "$.citation_indices", "array<variant>")
        return F.struct(
            v.isNull().alias("unreadable"), jx.is_object(v).alias("is_object"),
            jx.text_member(v, "$.outcome").alias("outcome"), jx.text_member(v, "$.reason_code").alias("reason"),
            (~jx.kind(jx.member(v, "$.reason_code")).isin("VOID", "STRING")).alias("reason_odd"),
            jx.text_member(v, "$.answer").alias("answer"), jx.is_list(jx.member(v, "$.citation_indices")).alias("listed"),
            _index_problem(items, upper, "citation_out_of_range", "citation_out_of_range", "duplicate_citation").alias("index_problem"),
            F.transform(items, jx.integer).alias("cited"),
        )

    def judge(f: Column) -> Column:
        outcome, reason, answer, cited = f["outcome"], f["reason"], f["answer"], f["cited"]
        bound = (
            F.when(outcome == "answered", reason.isNull())
            .when(outcome == "refused", reason.eqNullSafe(F.lit("insufficient_evidence")))
            .otherwise(reason.eqNullSafe(F.lit("version_conflict")))
        )
        marks = answer_markers(answer)
        problem = (
            F.when(f["unreadable"], "not_json")
            .when(~f["is_object"], "not_object")
            .when(outcome.isNull() | ~outcome.isin(*OUTCOMES), "bad_outcome")
            .when(f["reason_odd"] | (reason.isNotNull() & ~reason.isin(*REASON_CODES)), "bad_reason_code")
            .when((outcome == "conflict") & (F.size(required) == 0), "conflict_without_server_evidence")
            .when(~bound, "reason_code_outcome_mismatch")
            .when(answer.isNull() | (tx.strip_ws(answer) == ""), "empty_answer")
            .when(F.length(answer) > max_answer, "answer_too_long")
            .when(~f["listed"], "bad_citation_list")
            .when(f["index_problem"].isNotNull(), f["index_problem"])
            .when((outcome == "refused") & (F.size(cited) > 0), "refused_with_citations")
            .when((outcome != "refused") & (F.size(cited) == 0), "missing_citation")
            .when(F.size(F.array_except(required, cited)) > 0, "missing_required_citation")
            .when((F.size(F.array_except(marks, cited)) > 0) | (F.size(F.array_except(cited, marks)) > 0), "citation_marker_mismatch")
        )
        return F.struct(
            problem.alias("problem"), outcome.alias("outcome"), reason.alias("reason_code"), answer.alias("answer"), cited.alias("citations")
        )

    audited = tx.let(jx.strict_json(strip_fence(F.col("raw"))), lambda v: tx.let(read(v), judge))
    # a generator, so that a filter on the verdict doesn't take the audit along and run it twice
    return df.select(*df.columns, F.explode(F.array(audited)).alias("_a")).select(*df.columns, "_a.*")


def remap_answer(answer: Column, citations: Column) -> Column:
    """Rewrite ``[n]`` to the position of n in the citation list, all markers in one pass."""
    texts = F.split(answer, MARKER)
    marks = F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1))

    def mark(m: Column) -> Column:
        at = F.array_position(citations, m.try_cast("bigint"))
        return F.concat(F.lit("["), F.when(at > 0, at.cast("string")).otherwise(m), F.lit("]"))

    return tx.let(
        F.transform(marks, mark),
        lambda ms: F.array_join(
            F.transform(texts, lambda t, i: F.concat(t, F.coalesce(F.get(ms, i), F.lit("")))), ""
        ),
    )


def citation_rows(completions: DataFrame, ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """One row per cited index joined to the ranked result of that number."""
    cited = completions.select(key, F.posexplode("citations").alias("p", "evidence_no"))
    return cited.join(ranked, [key, "evidence_no"]).withColumn("citation_index", F.col("p") + 1).drop("p")


def final_outcome(df: DataFrame) -> DataFrame:
    """Active conflict wins; a refusal takes the fixed text of its reason; else the renumbered answer."""
    texts = F.create_map(*[F.lit(x) for pair in REFUSAL_TEXT.items() for x in pair])
    active = F.coalesce("conflict_active", F.lit(False))
    refused = (F.col("outcome") == "refused") & ~active
    reason = F.coalesce("reason_code", F.lit("insufficient_evidence"))
    return df.select(
        *[c for c in df.columns if c not in ("outcome", "reason_code", "answer")],
        F.when(active, "conflict").otherwise(F.col("outcome")).alias("outcome"),
        F.when(active, F.lit("version_conflict")).when(refused, reason).otherwise(F.col("reason_code")).alias("reason_code"),
        F.when(refused, F.try_element_at(texts, reason)).otherwise(remap_answer(F.col("answer"), F.col("citations"))).alias("answer"),
        (active & (F.col("outcome") != "conflict")).alias("forced_conflict"),
    )


# --- judge (E30, E31) -----------------------------------------------------------------

def audit_judge(df: DataFrame) -> DataFrame:
    """First contract violation of a judge answer, else the verdict derived from its facts.

    Input: raw, fact_count, evidence_count.
    """
    fact_count, evidence_count = F.col("fact_count"), F.col("evidence_count")
    fact_keys = F.array(*[F.lit(k) for k in FACT_KEYS])
    allowed = F.array(F.lit("fact_results"), F.lit("verdict"))

    def flag(item: Column, name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "boolean")

    def fact_problem(item: Column, i: Column, ids: Column) -> Column:
        fid = F.get(ids, i)
        indices = F.try_variant_get(item, "$.evidence_indices", "array<variant>")
        index_problem = _index_problem(
            indices, evidence_count, "bad_evidence_indices", "evidence_out_of_range", "duplicate_evidence_index"
        )
        supports = flag(item, "evidence_supports")
        booleans = F.array(*[jx.kind(jx.member(item, f"$.{n}")) for n in ("answer_expresses", "evidence_supports")])
        return (
            F.when(~jx.is_object(item), "bad_fact_result_item")
            .when(F.size(F.array_except(jx.keys(item), fact_keys)) > 0, "extra_fact_keys")
            .when(F.size(F.array_except(fact_keys, jx.keys(item))) > 0, "missing_fact_keys")
            .when(fid.isNull() | (fid < 1) | (fid > fact_count), "bad_fact_index")
            .when(F.array_position(ids, fid) < i + 1, "duplicate_fact")
            .when(F.exists(booleans, lambda b: b != "BOOLEAN"), "bad_bool")
            .when(~jx.is_list(jx.member(item, "$.evidence_indices")), "bad_evidence_indices")
            .when(index_problem.isNotNull(), index_problem)
            .when(supports & (F.size(indices) == 0), "supported_without_evidence")
            .when(~supports & (F.size(indices) > 0), "unsupported_with_evidence")
        )

    def read(v: Column) -> Column:
        facts = F.try_variant_get(v, "$.fact_results", "array<variant>")
        ids = F.transform(facts, lambda f: jx.integer(jx.member(f, "$.fact_index")))
        return F.struct(
            v.isNull().alias("unreadable"), jx.is_object(v).alias("is_object"), F.when(jx.is_object(v), jx.keys(v)).alias("top"),
            jx.is_list(jx.member(v, "$.fact_results")).alias("listed"), F.size(facts).alias("n"),
            tx.let(ids, lambda xs: _first(F.transform(facts, lambda f, i: fact_problem(f, i, xs)))).alias("fact_problem"),
            F.transform(
                facts,
                lambda f: F.coalesce(flag(f, "answer_expresses") & flag(f, "evidence_supports"), F.lit(False)),
            ).alias("supported"),
            jx.kind(jx.member(v, "$.verdict")).alias("verdict_kind"), jx.text_member(v, "$.verdict").alias("verdict"),
        )

    def judge(f: Column) -> Column:
        reason = (
            F.when(fact_count <= 0, "no_facts")
            .when(f["unreadable"], "not_json")
            .when(~f["is_object"], "not_object")
            .when(F.size(F.array_except(f["top"], allowed)) > 0, "extra_keys")
            .when(~F.coalesce(F.array_contains(f["top"], "fact_results"), F.lit(False)), "missing_keys")
            .when(~f["listed"] | (F.coalesce(f["n"], F.lit(0)) < 1), "bad_fact_results")
            .when(f["fact_problem"].isNotNull(), f["fact_problem"])
            .when(f["n"] != fact_count, "fact_coverage")
            .when((f["verdict_kind"] != "VOID") & ~F.coalesce(f["verdict"].isin(*VERDICTS), F.lit(False)), "bad_verdict")
        )
        derived = (
            F.when(F.forall(f["supported"], lambda x: x), "supported")
            .when(F.exists(f["supported"], lambda x: x), "partially_supported").otherwise("unsupported")
        )
        return tx.let(reason, lambda r: F.struct(r.alias("reason"), F.when(r.isNull(), derived).alias("verdict")))

    audited = tx.let(jx.strict_json(strip_fence(F.col("raw"))), lambda v: tx.let(read(v), judge))
    # a generator, so that a filter on the verdict doesn't take the audit along and run it twice
    return df.select(*df.columns, F.explode(F.array(audited)).alias("_a")).select(*df.columns, "_a.*")


def judge_request(cases: DataFrame, evidence: DataFrame, key: str = "case_id") -> DataFrame:
    """JSON request per case: question, numbered facts, answer, cited evidence (at most ten rows)."""
    ev = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "quote"))).alias("evidence"))
    facts = F.transform("facts", lambda f, i: F.struct((i + 1).alias("fact_index"), f.alias("fact")))
    j = cases.join(ev, key, "left")
    empty = F.array().cast("array<struct<index:int,quote:string>>")
    return j.select(
        key, F.to_json(F.struct("question", facts.alias("facts"), "answer", F.coalesce("evidence", empty).alias("evidence"))).alias("request")
    )
