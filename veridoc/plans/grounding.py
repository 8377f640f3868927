"""Conflict, conversation, completion and judge queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions import text as tx
from veridoc.functions.digest import sha256
from veridoc.operators import conflicts as cf
from veridoc.operators import grounding as gr
from veridoc.plans.registry import query
from veridoc.session import Tables

# --- conflicts ---------------------------------------------------------------------

OBS_SQL = """
obs AS (SELECT o_custkey AS group_id, o_orderpriority AS key, o_orderstatus AS version, floor(o_totalprice / 1000)::BIGINT::VARCHAR AS value, o_orderkey AS idx FROM orders),
fv AS (SELECT group_id, key, version, arg_min(value, idx) AS value, min(idx) AS idx FROM obs GROUP BY ALL)"""


def observed(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("version"),
        F.floor(F.col("o_totalprice") / 1000).cast("string").alias("value"), F.col("o_orderkey").alias("idx"), F.lit(0).alias("pos"),
    )


@query(
    "field_pairs", "G5",
    """SELECT o_orderkey AS idx, 0 AS pos, 'priority' AS key, lower(replace(o_orderpriority, ' ', '')) AS value FROM orders
UNION ALL SELECT o_orderkey, 1, 'total', floor(o_totalprice)::BIGINT::VARCHAR FROM orders""",
)
def field_pairs(t: Tables) -> DataFrame:
    """``priority：…`` and ``total：…`` on two lines, with a metadata key in between."""
    text = F.concat(
        F.lit("priority： "), "o_orderpriority", F.lit("\n文档版本：2025.1\ntotal："), F.floor("o_totalprice").cast("string")
    )
    ev = t.orders.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("idx"), text.alias("text"), F.lit("v").alias("version"))
    return cf.observed_pairs(ev).select("idx", "pos", "key", "value")


@query(
    "cross_version_conflicts", "G6",
    f"""WITH {OBS_SQL}, x AS (SELECT DISTINCT a.group_id, a.key, a.version, a.idx FROM fv a JOIN fv b
 ON a.group_id = b.group_id AND a.key = b.key AND a.version <> b.version AND a.value <> b.value AND a.idx <> b.idx)
SELECT group_id, key, count(*) AS n_versions, min(idx) AS lo, max(idx) AS hi FROM x GROUP BY group_id, key""",
)
def cross_version_conflicts(t: Tables) -> DataFrame:
    return cf.cross_version_fields(observed(t))


_PART_SQL = """part_ AS (SELECT DISTINCT a.group_id, a.key, a.version, a.value, a.idx FROM fv a JOIN fv b
 ON a.group_id = b.group_id AND a.key = b.key AND a.version <> b.version AND a.value <> b.value AND a.idx <> b.idx)"""


@query("cross_version_participants", "G6", f"WITH {OBS_SQL}, {_PART_SQL} SELECT * FROM part_")
def cross_version_participants(t: Tables) -> DataFrame:
    return cf.cross_version_participants(observed(t))


@query(
    "row_record_lines", "G7",
    """SELECT o_orderkey AS idx, 0 AS line, o_orderstatus AS a, o_orderpriority AS b, o_custkey || '|' || year(o_orderdate) AS body FROM orders
UNION ALL SELECT o_orderkey, 1, 'status=' || lower(o_orderstatus), 'priority=' || lower(replace(o_orderpriority, ' ', '')), 'customer=' || o_custkey FROM orders""",
)
def row_record_lines(t: Tables) -> DataFrame:
    cust, year = F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")
    text = F.concat(
        F.lit("| "), "o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit(" | "), cust, F.lit("\t"), year,
        F.lit("\n\nplain line\nstatus: "), "o_orderstatus", F.lit("；priority："), "o_orderpriority", F.lit("; customer: "), cust,
    )
    ev = t.orders.select(F.lit(0).alias("group_id"), F.lit("d").alias("doc_id"), F.col("o_orderkey").alias("idx"), text.alias("text"))
    return cf.row_records(ev).select("idx", F.when(F.contains("a", F.lit("=")), 1).otherwise(0).alias("line"), "a", "b", "body")


SLOT_SQL = """
sl AS (SELECT l_suppkey::VARCHAR AS doc_id, l_returnflag AS a, strftime(l_shipdate, '%Y-%m') AS b, l_partkey::VARCHAR AS body, l_orderkey AS idx, (l_orderkey, l_linenumber) AS pos FROM lineitem),
bo AS (SELECT doc_id, a, b, body, min(pos) AS fp FROM sl GROUP BY ALL),
f0 AS (SELECT doc_id, a, b, min(fp) AS p0, arg_min(body, fp) AS b0 FROM bo GROUP BY ALL),
f1 AS (SELECT bo.doc_id, bo.a, bo.b, min(fp) AS p1 FROM bo JOIN f0 USING (doc_id, a, b) WHERE body <> b0 GROUP BY ALL),
hits AS (SELECT DISTINCT sl.doc_id, sl.a, sl.b, idx FROM sl JOIN f0 USING (doc_id, a, b) JOIN f1 USING (doc_id, a, b) WHERE body <> b0 OR pos > p1 OR pos = p0)"""


def slots(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_suppkey", "l_returnflag", "l_shipdate", "l_partkey", "l_orderkey", "l_linenumber")
    return li.select(
        F.lit(0).alias("group_id"), F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_returnflag").alias("a"),
        F.date_format("l_shipdate", "yyyy-MM").alias("b"), F.col("l_partkey").cast("string").alias("body"), F.col("l_orderkey").alias("idx"),
        F.struct(F.col("l_orderkey"), F.col("l_linenumber")).alias("pos"),
    )


@query("row_slot_conflicts", "G8", f"WITH {SLOT_SQL} SELECT doc_id, a, b, idx FROM hits")
def row_slot_conflicts(t: Tables) -> DataFrame:
    return cf.slot_hits(slots(t)).drop("group_id")


_SUM_SQL = f"""{OBS_SQL}, {_PART_SQL},
gs AS (SELECT o_custkey AS group_id, l_returnflag AS a, strftime(l_shipdate, '%Y') AS b, l_partkey::VARCHAR AS body, l_orderkey AS idx, (l_orderkey, l_linenumber, l_suppkey) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
gbo AS (SELECT group_id, a, b, body, min(pos) AS fp FROM gs GROUP BY ALL),
g0 AS (SELECT group_id, a, b, min(fp) AS p0, arg_min(body, fp) AS b0 FROM gbo GROUP BY ALL),
g1 AS (SELECT gbo.group_id, gbo.a, gbo.b, min(fp) AS p1 FROM gbo JOIN g0 USING (group_id, a, b) WHERE body <> b0 GROUP BY ALL),
gh AS (SELECT DISTINCT gs.group_id, gs.a, gs.b, idx FROM gs JOIN g0 USING (group_id, a, b) JOIN g1 USING (group_id, a, b) WHERE body <> b0 OR pos > p1 OR pos = p0),
keys AS (SELECT DISTINCT group_id, 'cross_version' AS signal, key FROM part_ UNION SELECT DISTINCT group_id, 'row_slot', a || '|' || b FROM gh),
ix AS (SELECT group_id, idx FROM part_ UNION SELECT group_id, idx FROM gh),
summ AS (SELECT k.group_id, field_count, has_cross, has_slot, n_indices, first_index, field_digest FROM
 (SELECT group_id, count(*) AS field_count, bool_or(signal = 'cross_version') AS has_cross, bool_or(signal = 'row_slot') AS has_slot FROM keys GROUP BY 1) k
 JOIN (SELECT group_id, count(*) AS n_indices, min(idx) AS first_index FROM ix GROUP BY 1) i USING (group_id)
 JOIN (SELECT group_id, sum(CAST('0x' || substr(sha256(signal || chr(31) || lower(replace(key, ' ', ''))), 1, 15) AS UBIGINT)::HUGEINT)::VARCHAR AS field_digest FROM keys GROUP BY 1) d USING (group_id))"""


def customer_conflicts(t: Tables) -> tuple[DataFrame, DataFrame]:
    parts = cf.cross_version_participants(observed(t))
    li = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("group_id")), "l_orderkey")
    rows = li.select(
        "group_id", F.lit("").alias("doc_id"), F.col("l_returnflag").alias("a"), F.year("l_shipdate").cast("string").alias("b"),
        F.col("l_partkey").cast("string").alias("body"), F.col("l_orderkey").alias("idx"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("pos"),
    )
    return parts, cf.slot_hits(rows)


def customer_summary(t: Tables) -> DataFrame:
    return cf.conflict_summary(*customer_conflicts(t))


@query("conflict_summary", "G9", f"WITH {_SUM_SQL} SELECT * FROM summ")
def conflict_summary(t: Tables) -> DataFrame:
    return customer_summary(t)


@query(
    "conflict_members", "G9",
    f"""WITH {_SUM_SQL} SELECT group_id, 'index' AS member, idx, NULL::VARCHAR AS signal, NULL::VARCHAR AS key FROM ix
UNION ALL SELECT group_id, 'field', NULL, signal, key FROM keys""",
)
def conflict_members(t: Tables) -> DataFrame:
    """The indices and field keys behind ``conflict_summary``, all of them, in order."""
    return cf.conflict_members(*customer_conflicts(t))


MARKS = cf.Markers(
    cross=("versionsdiffer", "acrossfiles"), compare=("on", "the"), scope=("tion", "que"), slot=("heit", "sch"),
    slot_context=("en", "er"), slot_query=("an", "de"), weekday="di", period=r"\d+",
)


@query(
    "conflict_activation", "G3,G4,G10",
    f"""WITH {_SUM_SQL}, q AS (SELECT conv_id, turn, lower(regexp_replace(text, '\\s+', '', 'g')) AS q FROM conversations),
i AS (SELECT conv_id, turn, contains(q, 'versionsdiffer') OR contains(q, 'acrossfiles') OR (regexp_matches(q, 'on|the') AND (regexp_matches(q, 'tion|que')
  OR len(list_distinct(regexp_extract_all(q, '[0-9]{{4}}[.][0-9]{{1,2}}'))) >= 2)) AS ci,
  regexp_matches(q, 'heit|sch') OR (regexp_matches(q, 'en|er') AND (contains(q, 'di') OR regexp_matches(q, '[0-9]+')) AND regexp_matches(q, 'an|de')) AS si FROM q)
SELECT conv_id, turn, ci AS cross_intent, si AS slot_intent, coalesce(CASE WHEN has_cross AND has_slot THEN ci OR si WHEN has_slot THEN si WHEN has_cross THEN ci END, false) AS activated,
CASE WHEN has_cross AND has_slot AND NOT (ci OR si) THEN 'conflict_intent_not_requested' WHEN has_slot AND NOT has_cross AND NOT si THEN 'row_slot_not_requested'
WHEN has_cross AND NOT has_slot AND NOT ci THEN 'cross_version_not_requested' END AS suppression FROM i LEFT JOIN summ ON group_id = conv_id""",
)
def conflict_activation(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("ci", cf.cross_version_intent(F.col("text"), MARKS)).withColumn(
        "si", cf.row_slot_intent(F.col("text"), MARKS)
    )
    j = c.join(customer_summary(t), F.col("conv_id") == F.col("group_id"), "left")
    active, reason = cf.activation(F.col("has_cross"), F.col("has_slot"), F.col("ci"), F.col("si"))
    return j.select(
        "conv_id", "turn", F.col("ci").alias("cross_intent"), F.col("si").alias("slot_intent"),
        active.alias("activated"), reason.alias("suppression"),
    )


@query(
    "conflict_diagnostics", "G11",
    f"""WITH {OBS_SQL}, {_PART_SQL}, v AS (SELECT group_id, count(DISTINCT version) AS n_versions FROM obs GROUP BY 1),
m AS (SELECT v.group_id, n_versions, coalesce(bool_or(contains('isthe1-urgentorderconsistent', lower(replace(key, ' ', '')))), false) AS mentions_field FROM v LEFT JOIN part_ USING (group_id) GROUP BY ALL)
SELECT * FROM m""",
)
def conflict_diagnostics(t: Tables) -> DataFrame:
    obs = observed(t)
    versions = cf.distinct_versions(obs)
    asked = versions.select("group_id", F.lit("Is the 1-URGENT order consistent").alias("question"))
    mentions = cf.question_mentions(asked, cf.cross_version_participants(obs))
    return versions.join(mentions, "group_id")


@query(
    "planning_guard", "G2",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'heit|tion') THEN 'planning_unavailable' END AS reason FROM conversations""",
)
def planning_guard(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", cf.planning_guard(F.col("text"), ("heit", "tion")).alias("reason"))


# --- conversations -------------------------------------------------------------------

TURN_SQL = """
tv AS (SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars, max(length(text)) AS longest, bool_or(role NOT IN ('user', 'assistant')) AS bad_role,
  arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id),
tc AS (SELECT *, CASE WHEN n_messages > 10 THEN 'too_many_messages' WHEN bad_role THEN 'bad_role' WHEN longest > 4000 THEN 'message_too_long' WHEN last_role <> 'user' THEN 'last_not_user'
  WHEN trim(last_text) = '' THEN 'empty_question' WHEN n_chars > 12000 THEN 'conversation_too_long' END AS reason FROM tv)"""


@query(
    "turn_validation", "G1",
    f"WITH {TURN_SQL} SELECT conv_id, n_messages, n_chars, reason, CASE WHEN reason IS NULL THEN sha256(trim(last_text, chr(10) || ' ')) END AS question_sha FROM tc",
)
def turn_validation(t: Tables) -> DataFrame:
    return gr.check_turns(t.conversations).select("conv_id", "n_messages", "n_chars", "reason", sha256(F.col("question")).alias("question_sha"))


@query(
    "turn_history", "G1",
    f"""WITH {TURN_SQL}, h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no, role, sha256(text) AS text_sha, count(*) OVER (PARTITION BY conv_id) AS n
 FROM conversations WHERE conv_id IN (SELECT conv_id FROM tc WHERE reason IS NULL))
SELECT conv_id, (no - 1)::INT AS position, role, text_sha FROM h WHERE no < n""",
)
def turn_history(t: Tables) -> DataFrame:
    return gr.assemble_turns(t.conversations).select("conv_id", F.posexplode("history").alias("position", "h")).select(
        "conv_id", "position", "h.role", sha256(F.col("h.text")).alias("text_sha")
    )


# --- completions -----------------------------------------------------------------------

# One malformed or valid answer per order, chosen by its priority, status and month.
KIND_SQL = """CASE WHEN m = 1 THEN 'not_json' WHEN m = 2 THEN 'not_object' WHEN m = 3 AND p = '1-URGENT' THEN 'bad_outcome' WHEN m = 3 AND p = '2-HIGH' THEN 'bad_reason_code'
 WHEN m = 3 THEN 'conflict_without_server_evidence' WHEN m = 4 THEN 'reason_code_outcome_mismatch' WHEN m = 5 AND s = 'F' THEN 'empty_answer' WHEN m = 5 AND s = 'O' THEN 'answer_too_long'
 WHEN m = 5 THEN 'bad_citation_list' WHEN m = 6 AND s = 'F' THEN 'citation_out_of_range' WHEN m = 6 AND s = 'O' THEN 'duplicate_citation' WHEN m = 6 THEN 'refused_with_citations'
 WHEN m = 7 AND s = 'F' THEN 'missing_citation' WHEN m = 7 AND s = 'O' THEN 'missing_required_citation' WHEN m = 7 THEN 'citation_marker_mismatch' WHEN m = 8 THEN 'refused' WHEN m = 9 THEN 'conflict' ELSE 'answered' END"""


def completions(t: Tables) -> DataFrame:
    """Raw model answers rendered from orders; the kind column says what was put in."""
    kind = F.expr(KIND_SQL.replace("m =", "month(o_orderdate) =").replace("AND p =", "AND o_orderpriority =").replace("AND s =", "AND o_orderstatus ="))
    return t.wide("orders").select(F.col("o_orderkey").alias("query_id"), "o_custkey", tx.let(kind, render_completion).alias("c")).select(
        "query_id", "o_custkey", "c.*", F.lit(5).alias("evidence_count")
    )


def render_completion(k: Column) -> Column:
    outcome = (
        F.when(k == "bad_outcome", '"maybe"').when(k.isin("conflict_without_server_evidence", "conflict"), '"conflict"')
        .when(k.isin("refused", "refused_with_citations"), '"refused"').otherwise('"answered"')
    )
    reason = (
        F.when(k == "bad_reason_code", '"whatever"').when(k == "reason_code_outcome_mismatch", '"no_evidence"')
        .when(k.isin("refused", "refused_with_citations"), '"insufficient_evidence"')
        .when(k.isin("conflict_without_server_evidence", "conflict"), '"version_conflict"').otherwise("null")
    )
    answer = (
        F.when(k == "empty_answer", '" "').when(k == "answer_too_long", F.concat(F.lit('"'), F.repeat(F.lit("x"), 4001), F.lit('"')))
        .when(k == "citation_marker_mismatch", '"see [3] and [2]"').when(k == "refused", '"no answer"')
        .otherwise(F.concat(F.lit('"first [3] of '), F.col("o_custkey").cast("string"), F.lit(' then [1], again [3] and [77a] [1]"')))
    )
    cites = (
        F.when(k == "bad_citation_list", '"3"').when(k == "citation_out_of_range", "[3, true, 3]").when(k == "duplicate_citation", "[3, 1, 3, 99]")
        .when(k.isin("missing_citation", "refused"), "[]").otherwise("[3,1]")
    )
    body = F.concat(
        F.lit('{"outcome": '), outcome, F.lit(', "reason_code": '), reason, F.lit(', "answer": '), answer, F.lit(', "citation_indices": '), cites, F.lit("}")
    )
    raw = (
        F.when(k == "not_json", F.concat(body, F.lit("}"))).when(k == "not_object", F.lit("[1]"))
        .when(k == "answered", F.concat(F.lit("```JSON\n"), body, F.lit("\n```"))).otherwise(body)
    )
    required = F.when(k == "conflict", F.array(F.lit(1))).when(k == "missing_required_citation", F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.struct(k.alias("kind"), raw.alias("raw"), required.cast("array<bigint>").alias("required_indices"))


_COMP_SQL = f"""comp AS (SELECT o_orderkey AS query_id, o_custkey, {KIND_SQL} AS kind FROM (SELECT *, month(o_orderdate) AS m, o_orderpriority AS p, o_orderstatus AS s FROM orders)),
good AS (SELECT *, kind AS outcome FROM comp WHERE kind IN ('answered', 'refused', 'conflict'))"""


@query(
    "completion_audit", "G12",
    f"WITH {_COMP_SQL} SELECT query_id, kind, CASE WHEN kind NOT IN ('answered', 'refused', 'conflict') THEN kind END AS problem FROM comp",
)
def completion_audit(t: Tables) -> DataFrame:
    return gr.audit_completions(completions(t)).select("query_id", "kind", "problem")


@query(
    "citation_remap", "G13",
    f"""WITH {_COMP_SQL} SELECT query_id, CASE WHEN kind = 'refused' THEN 'no answer' ELSE 'first [1] of ' || o_custkey || ' then [2], again [1] and [77a] [2]' END AS answer FROM good""",
)
def citation_remap(t: Tables) -> DataFrame:
    ok = gr.audit_completions(completions(t)).where("problem IS NULL")
    return ok.select("query_id", gr.remap_answer(F.col("answer"), F.col("citations")).alias("answer"))


def order_evidence(t: Tables) -> DataFrame:
    """Every line of an order as its evidence, numbered in order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linestatus", F.row_number().over(w).alias("no"))


# citations of the valid answers: position in the answer and number of the evidence
CITED_SQL = f"""{_COMP_SQL}, cited AS (SELECT query_id, unnest([1, 2]) AS citation_index, unnest([3, 1]) AS evidence_no FROM good WHERE kind <> 'refused')"""

EVIDENCE_SQL = """rk AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS evidence_no,
 l_partkey AS chunk_id, l_linestatus FROM lineitem)"""


@query(
    "citation_rows", "G14",
    f"""WITH {CITED_SQL}, {EVIDENCE_SQL}
SELECT query_id, citation_index::INT AS citation_index, evidence_no::INT AS evidence_no, chunk_id FROM cited JOIN rk USING (query_id, evidence_no)""",
)
def citation_rows(t: Tables) -> DataFrame:
    ok = gr.audit_completions(completions(t)).where("problem IS NULL")
    ranked = order_evidence(t).select(F.col("l_orderkey").alias("query_id"), F.col("no").cast("bigint").alias("evidence_no"), F.col("l_partkey").alias("chunk_id"))
    return gr.citation_rows(ok, ranked).select(
        "query_id", "citation_index", F.col("evidence_no").cast("int").alias("evidence_no"), "chunk_id"
    )


@query(
    "outcome_rewrite", "G15",
    f"""WITH {_COMP_SQL} SELECT query_id, CASE WHEN kind = 'conflict' OR o_custkey < 50 THEN 'conflict' ELSE kind END AS outcome,
CASE WHEN kind = 'conflict' OR o_custkey < 50 THEN 'version_conflict' WHEN kind = 'refused' THEN 'insufficient_evidence' END AS reason_code,
CASE WHEN kind = 'refused' AND o_custkey < 50 THEN 'no answer' WHEN kind = 'refused' THEN '现有资料不足以支持确定的结论，无法回答。'
 ELSE 'first [1] of ' || o_custkey || ' then [2], again [1] and [77a] [2]' END AS answer, o_custkey < 50 AND kind <> 'conflict' AS forced_conflict FROM good""",
)
def outcome_rewrite(t: Tables) -> DataFrame:
    ok = gr.audit_completions(completions(t)).where("problem IS NULL").withColumn("conflict_active", F.col("o_custkey") < 50)
    return gr.final_outcome(ok).select("query_id", "outcome", "reason_code", "answer", "forced_conflict")


# --- judge ----------------------------------------------------------------------------

JUDGE_KIND = """CASE m WHEN 1 THEN 'not_json' WHEN 2 THEN 'not_object' WHEN 3 THEN CASE s WHEN 'F' THEN 'extra_keys' WHEN 'O' THEN 'missing_keys' ELSE 'bad_fact_results' END
 WHEN 4 THEN CASE s WHEN 'F' THEN 'bad_fact_result_item' WHEN 'O' THEN 'extra_fact_keys' ELSE 'missing_fact_keys' END WHEN 5 THEN CASE s WHEN 'F' THEN 'bad_fact_index' WHEN 'O' THEN 'duplicate_fact' ELSE 'fact_coverage' END
 WHEN 6 THEN CASE s WHEN 'F' THEN 'bad_bool' WHEN 'O' THEN 'bad_evidence_indices' ELSE 'evidence_out_of_range' END WHEN 7 THEN CASE s WHEN 'F' THEN 'duplicate_evidence_index' WHEN 'O' THEN 'supported_without_evidence' ELSE 'unsupported_with_evidence' END
 WHEN 8 THEN CASE s WHEN 'F' THEN 'bad_verdict' WHEN 'O' THEN 'no_facts' ELSE 'partially_supported' END WHEN 9 THEN 'unsupported' ELSE 'supported' END"""


def judge_outputs(t: Tables) -> DataFrame:
    kind = F.expr(JUDGE_KIND.replace("CASE m", "CASE month(o_orderdate)").replace("CASE s", "CASE o_orderstatus"))
    return t.wide("orders").select(F.col("o_orderkey").alias("case_id"), tx.let(kind, render_judgement).alias("c")).select(
        "case_id", "c.*", F.lit(3).alias("evidence_count")
    )


def render_judgement(k: Column) -> Column:
    def fact(index, expresses, supports, ids) -> Column:
        return F.concat(
            F.lit('{"fact_index":'), index, F.lit(',"answer_expresses":'), expresses, F.lit(',"evidence_supports":'), supports,
            F.lit(',"evidence_indices":'), ids,
        )

    one = fact(
        F.when(k == "bad_fact_index", "9").otherwise("1"), F.when(k == "bad_bool", '"yes"').when(k == "unsupported", "false").otherwise("true"),
        F.when(k.isin("unsupported", "unsupported_with_evidence"), "false").otherwise("true"),
        F.when(k == "bad_evidence_indices", "[true]").when(k == "evidence_out_of_range", "[1,7]").when(k == "duplicate_evidence_index", "[2,2]")
        .when(k.isin("supported_without_evidence", "unsupported"), "[]").otherwise("[1,2]"),
    )
    one = F.concat(
        F.when(k == "missing_fact_keys", '{"fact_index":1').otherwise(one), F.when(k == "extra_fact_keys", ',"note":1').otherwise(""), F.lit("}")
    )
    two = F.concat(
        fact(F.when(k == "duplicate_fact", "1").otherwise("2"), F.lit("true"), F.when(k.isin("unsupported", "partially_supported"), "false").otherwise("true"),
             F.when(k.isin("unsupported", "partially_supported"), "[]").otherwise("[3]")), F.lit("}"),
    )
    items = (
        F.when(k == "bad_fact_result_item", "[1]").when(k == "bad_fact_results", "[]").when(k == "fact_coverage", F.concat(F.lit("["), one, F.lit("]")))
        .otherwise(F.concat(F.lit("["), one, F.lit(","), two, F.lit("]")))
    )
    raw = (
        F.when(k == "not_json", "{").when(k == "not_object", '"text"').when(k == "missing_keys", "{}")
        .otherwise(
            F.concat(
                F.lit('{"fact_results":'), items, F.when(k == "extra_keys", ',"comment":"x"').when(k == "bad_verdict", ',"verdict":"fine"').otherwise(',"verdict":"supported"'), F.lit("}"),
            )
        )
    )
    return F.struct(k.alias("kind"), raw.alias("raw"), F.when(k == "no_facts", 0).otherwise(2).alias("fact_count"))


@query(
    "judge_audit", "E30",
    f"""WITH j AS (SELECT o_orderkey AS case_id, {JUDGE_KIND} AS kind FROM (SELECT *, month(o_orderdate) AS m, o_orderstatus AS s FROM orders))
SELECT case_id, kind, CASE WHEN kind NOT IN ('supported', 'partially_supported', 'unsupported') THEN kind END AS reason, CASE WHEN kind IN ('supported', 'partially_supported', 'unsupported') THEN kind END AS verdict FROM j""",
)
def judge_audit(t: Tables) -> DataFrame:
    return gr.audit_judge(judge_outputs(t)).select("case_id", "kind", "reason", "verdict")


@query(
    "judge_requests", "E31",
    """WITH e AS (SELECT l_orderkey, '[' || string_agg('{"index":' || no || ',"quote":"' || l_partkey || '"}', ',' ORDER BY no) || ']' AS ev FROM
 (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS no FROM lineitem) GROUP BY 1)
SELECT o_orderkey AS case_id, '{"question":"' || o_orderpriority || '","facts":[{"fact_index":1,"fact":"' || o_orderstatus || '"},{"fact_index":2,"fact":"second"}],"answer":"a","evidence":' || coalesce(ev, '[]') || '}' AS request
FROM orders LEFT JOIN e ON l_orderkey = o_orderkey""",
)
def judge_requests(t: Tables) -> DataFrame:
    ev = order_evidence(t).select(F.col("l_orderkey").alias("case_id"), F.col("no").alias("index"), F.col("l_partkey").cast("string").alias("quote"))
    cases = t.orders.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("question"),
        F.array(F.col("o_orderstatus"), F.lit("second")).alias("facts"), F.lit("a").alias("answer"),
    )
    return gr.judge_request(cases, ev)
