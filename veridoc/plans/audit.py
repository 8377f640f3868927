"""Requirement-audit queries over line items, parts and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import text as tx
from veridoc.operators import audit as au
from veridoc.plans.registry import query
from veridoc.session import Tables, shuffled

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
VERSIONS = ("2025.1", "2026.1")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
UNLISTED_BRANDS = ("Brand#1", "Brand#2", "Brand#3")

_SEG = ", ".join(f"'{s}'" for s in SEGMENTS)
_TYP = ", ".join(f"'{s}'" for s in TYPES)
_OUT = ", ".join(f"'{s}'" for s in UNLISTED_BRANDS)

AUDIT_SQL = f"""
rec AS (SELECT o_custkey AS set_id, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord, l_partkey::VARCHAR AS code,
  CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'N' THEN 'in_progress' ELSE 'failed' END AS status,
  round(l_quantity / 10, 1)::DECIMAL(10,4) AS credits,
  CASE l_linenumber WHEN 5 THEN 'OTHER' WHEN 7 THEN NULL ELSE p_type END AS category
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
rs AS (SELECT s || ':' || v AS rule_set_id, s AS major, v AS rule_version, CASE v WHEN '2025.1' THEN 155 ELSE 160 END::DECIMAL(10,4) AS required
  FROM (SELECT unnest([{_SEG}]) AS s), (SELECT unnest(['2025.1', '2026.1']) AS v)),
pairs AS (SELECT c_custkey AS set_id, rule_set_id FROM customer JOIN rs ON major = c_mktsegment),
cats AS (SELECT rule_set_id, i::INT AS ordinal, ([{_TYP}])[i + 1] AS category,
  (5 + i + CASE rule_version WHEN '2025.1' THEN 0 ELSE 1 END)::DECIMAL(10,4) AS minimum FROM rs, range(6) r(i)),
cat AS (SELECT rule_set_id, p_partkey::VARCHAR AS code, p_name AS name,
  (round(p_size / 10, 1)::DECIMAL(10,4) + CASE rule_version WHEN '2025.1' THEN 0 ELSE 0.5 END)::DECIMAL(10,4) AS credits, p_type AS category
  FROM rs, part WHERE p_brand NOT IN ({_OUT})),
req0 AS (SELECT p_type AS category, p_size // 10 AS band, min(p_partkey)::VARCHAR AS code FROM part GROUP BY ALL),
req AS (SELECT rule_set_id, ordinal, r.category, band AS position, code FROM cats JOIN req0 r ON r.category = cats.category),
st AS (SELECT set_id, code, bool_or(status = 'passed') AS passed, bool_or(status = 'in_progress') AS ongoing, bool_or(status = 'failed') AS failed,
  arg_min({{'c': category, 'k': credits}}, ord) FILTER (status = 'passed') AS p, arg_min({{'c': category, 'k': credits}}, ord) FILTER (status = 'in_progress') AS o
  FROM rec GROUP BY ALL),
res AS (SELECT set_id, code, CASE WHEN passed THEN 'passed' WHEN ongoing THEN 'in_progress' ELSE 'failed' END AS state,
  CASE WHEN passed THEN p.c ELSE o.c END AS rcat, CASE WHEN passed THEN p.k ELSE o.k END AS rcred,
  (failed AND (passed OR ongoing)) OR (passed AND ongoing) AS contradictory FROM st),
cr AS (SELECT set_id, pairs.rule_set_id, res.code, state, contradictory, coalesce(cat.category, rcat, '') AS category,
  coalesce(cat.credits, rcred) AS credits, cat.code IS NULL AS unlisted,
  cat.code IS NOT NULL AND coalesce(rcat, '') <> '' AND rcat <> cat.category AS mismatch
  FROM res JOIN pairs USING (set_id) LEFT JOIN cat ON cat.rule_set_id = pairs.rule_set_id AND cat.code = res.code WHERE state <> 'failed'),
tot0 AS (SELECT set_id, rule_set_id, round(coalesce(sum(credits) FILTER (state = 'passed'), 0), 1)::DECIMAL(12,1) AS completed,
  round(coalesce(sum(credits) FILTER (state = 'in_progress'), 0), 1)::DECIMAL(12,1) AS in_progress FROM cr GROUP BY ALL),
tot AS (SELECT pairs.set_id, pairs.rule_set_id, required, coalesce(completed, 0)::DECIMAL(12,1) AS completed, coalesce(in_progress, 0)::DECIMAL(12,1) AS in_progress,
  greatest(required - coalesce(completed, 0) - coalesce(in_progress, 0), 0)::DECIMAL(12,1) AS remaining
  FROM pairs JOIN rs USING (rule_set_id) LEFT JOIN tot0 ON tot0.set_id = pairs.set_id AND tot0.rule_set_id = pairs.rule_set_id),
gap0 AS (SELECT set_id, rule_set_id, category, round(coalesce(sum(credits) FILTER (state = 'passed'), 0), 1)::DECIMAL(12,1) AS completed,
  round(coalesce(sum(credits) FILTER (state = 'in_progress'), 0), 1)::DECIMAL(12,1) AS in_progress FROM cr GROUP BY ALL),
gap AS (SELECT pairs.set_id, pairs.rule_set_id, ordinal, cats.category, minimum AS required, coalesce(completed, 0)::DECIMAL(12,1) AS completed,
  coalesce(in_progress, 0)::DECIMAL(12,1) AS in_progress, greatest(minimum - coalesce(completed, 0) - coalesce(in_progress, 0), 0)::DECIMAL(12,1) AS remaining
  FROM pairs JOIN cats USING (rule_set_id) LEFT JOIN gap0 g ON g.set_id = pairs.set_id AND g.rule_set_id = pairs.rule_set_id AND g.category = cats.category),
mis AS (SELECT pairs.set_id, pairs.rule_set_id, req.ordinal, req.position, req.code, coalesce(cat.name, req.code) AS name,
  coalesce(cat.credits, 0)::DECIMAL(10,4) AS credits, coalesce(cat.category, req.category) AS category, cat.code IS NULL AS unknown
  FROM pairs JOIN req USING (rule_set_id) LEFT JOIN cat ON cat.rule_set_id = req.rule_set_id AND cat.code = req.code
  WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.set_id = pairs.set_id AND res.code = req.code AND state <> 'failed')),
wi AS (SELECT DISTINCT * FROM (
  SELECT set_id, p.rule_set_id, 0 AS ordinal, 'DEGREE_PLAN_VERSION_CONFLICT' AS code, b.rule_version AS item FROM pairs p JOIN rs a USING (rule_set_id)
    JOIN rs b ON a.major = b.major AND a.rule_version <> b.rule_version
  UNION ALL SELECT set_id, rule_set_id, 2, 'COURSE_CATEGORY_MISMATCH', code FROM cr WHERE mismatch
  UNION ALL SELECT set_id, rule_set_id, 3, 'COURSE_RECORD_CONTRADICTION', code FROM cr WHERE contradictory
  UNION ALL SELECT set_id, rule_set_id, 4, 'COURSE_NOT_IN_RULE_CATALOG', code FROM cr WHERE unlisted
  UNION ALL SELECT set_id, rule_set_id, 5, 'REQUIRED_COURSE_UNKNOWN', code FROM mis WHERE unknown))"""


class Inputs:
    """The audit tables derived from the driver tables."""

    def __init__(self, t: Tables):
        li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
        o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("set_id"))
        p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
        flag, line = F.col("l_returnflag"), F.col("l_linenumber")
        self.records = li.join(shuffled(o), "l_orderkey").join(shuffled(p), "l_partkey").select(
            "set_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ordinal"),
            F.col("l_partkey").cast("string").alias("course_code"),
            F.round(F.col("l_quantity") / 10, 1).cast(au.CREDIT).alias("credits"),
            F.when(line == 5, "OTHER").when(line != 7, F.col("p_type")).alias("category"),
            F.when(flag == "A", "passed").when(flag == "N", "in_progress").otherwise("failed").alias("status"),
        )
        ids = F.array(*[F.concat_ws(":", "c_mktsegment", F.lit(v)) for v in VERSIONS])
        self.pairs = t.customer.select(F.col("c_custkey").alias("set_id"), F.explode(ids).alias("rule_set_id"))
        later = F.col("rule_version") == VERSIONS[1]
        segments = t.customer.select(F.col("c_mktsegment").alias("major")).distinct()
        self.rule_sets = segments.select("major", F.explode(F.array(*[F.lit(v) for v in VERSIONS])).alias("rule_version")).select(
            F.concat_ws(":", "major", "rule_version").alias("rule_set_id"), "major", "rule_version",
            F.when(later, 160).otherwise(155).cast(au.CREDIT).alias("required_credits"),
        )
        types = F.array(*[F.lit(x) for x in TYPES])
        self.categories = self.rule_sets.select(
            "rule_set_id", "rule_version", F.posexplode(types).alias("ordinal", "category")
        ).select(
            "rule_set_id", "ordinal", "category",
            (F.lit(5) + F.col("ordinal") + F.when(later, 1).otherwise(0)).cast(au.CREDIT).alias("minimum_credits"),
        )
        # every listed part belongs to each of the ten rule sets
        rule_ids = F.array(*[F.lit(f"{s}:{v}") for s in SEGMENTS for v in VERSIONS])
        listed = t.part.where(~F.col("p_brand").isin(*UNLISTED_BRANDS))
        self.catalog = listed.select(F.explode(rule_ids).alias("rule_set_id"), "p_partkey", "p_name", "p_size", "p_type").select(
            "rule_set_id", F.col("p_partkey").cast("string").alias("course_code"), F.col("p_name").alias("course_name"),
            (F.round(F.col("p_size") / 10, 1).cast(au.CREDIT) + F.when(F.endswith("rule_set_id", F.lit(VERSIONS[1])), F.lit("0.5")).otherwise(F.lit("0")).cast("decimal(2,1)"))
            .cast(au.CREDIT).alias("credits"),
            F.col("p_type").alias("category"),
        )
        first = t.part.groupBy(F.col("p_type").alias("category"), F.floor(F.col("p_size") / 10).cast("int").alias("position")).agg(
            F.min("p_partkey").cast("string").alias("course_code")
        )
        self.required = self.categories.join(first, "category").select("rule_set_id", "ordinal", "category", "position", "course_code")
        self.resolved = au.resolve_status(self.records)
        self.credited = au.resolve_credit(self.resolved, self.pairs, self.catalog)

    def totals(self) -> DataFrame:
        return au.totals(self.pairs, self.credited, self.rule_sets)

    def gaps(self) -> DataFrame:
        return au.category_gaps(self.pairs, self.credited, self.categories)

    def missing(self) -> DataFrame:
        return au.missing_required(self.pairs, self.resolved, self.required, self.catalog)

    def plans(self) -> DataFrame:
        return au.plans_by_set(self.pairs, self.credited, self.rule_sets, self.categories, self.required, self.catalog)

    def items(self, time_items: DataFrame | None = None) -> DataFrame:
        return au.warning_items(self.pairs, self.credited, self.missing(), self.rule_sets, time_items)


@query("plan_status", "A11,A16", f"WITH {AUDIT_SQL} SELECT set_id, code AS course_code, state, rcat AS record_category, rcred AS record_credits, contradictory FROM res")
def plan_status(t: Tables) -> DataFrame:
    return Inputs(t).resolved


@query(
    "plan_credits", "A12",
    f"WITH {AUDIT_SQL} SELECT set_id, rule_set_id, code AS course_code, state, category, credits, unlisted, mismatch FROM cr",
)
def plan_credits(t: Tables) -> DataFrame:
    return Inputs(t).credited.drop("contradictory")


@query("plan_totals", "A11,A12,A13", f"WITH {AUDIT_SQL} SELECT set_id, rule_set_id, required, completed, in_progress, remaining FROM tot")
def plan_totals(t: Tables) -> DataFrame:
    return Inputs(t).totals()


@query(
    "plan_category_gaps", "A14",
    f"WITH {AUDIT_SQL} SELECT set_id, rule_set_id, ordinal, category, required, completed, in_progress, remaining FROM gap",
)
def plan_category_gaps(t: Tables) -> DataFrame:
    return Inputs(t).gaps()


@query(
    "plan_missing", "A7,A15",
    f"WITH {AUDIT_SQL} SELECT set_id, rule_set_id, ordinal, position::INT AS position, code AS course_code, name AS course_name, credits, category, unknown FROM mis",
)
def plan_missing(t: Tables) -> DataFrame:
    return Inputs(t).missing()


@query(
    "plan_contradictions", "A16",
    f"WITH {AUDIT_SQL} SELECT set_id, count(*) FILTER (contradictory) AS contradictions, count(*) AS courses FROM res GROUP BY set_id",
)
def plan_contradictions(t: Tables) -> DataFrame:
    return Inputs(t).resolved.groupBy("set_id").agg(
        F.count_if("contradictory").alias("contradictions"), F.count(F.lit(1)).alias("courses")
    )


@query(
    "plan_warnings", "A17,A24",
    f"""WITH {AUDIT_SQL} SELECT set_id, rule_set_id, ordinal, code, count(*) AS n_items, min(item) AS first_item, max(item) AS last_item FROM wi GROUP BY ALL""",
)
def plan_warnings(t: Tables) -> DataFrame:
    return au.warnings(Inputs(t).items())


@query("plan_warning_rows", "A24", f"WITH {AUDIT_SQL} SELECT set_id, rule_set_id, ordinal, code, item FROM wi")
def plan_warning_rows(t: Tables) -> DataFrame:
    return Inputs(t).items().select("set_id", "rule_set_id", "ordinal", "code", "item")


@query(
    "plan_warning_items", "A24",
    f"WITH {AUDIT_SQL} SELECT rule_set_id, code, item, count(*) AS n_sets FROM wi GROUP BY ALL",
)
def plan_warning_items(t: Tables) -> DataFrame:
    return Inputs(t).items().groupBy("rule_set_id", "code", "item").agg(F.count(F.lit(1)).alias("n_sets"))


@query(
    "plan_warning_evidence", "A25",
    f"""WITH {AUDIT_SQL}, w AS (SELECT DISTINCT set_id, rule_set_id, code FROM wi),
ev AS (SELECT DISTINCT * FROM (SELECT w.set_id, w.rule_set_id, w.code, 'order-' || o_orderkey AS chunk_id FROM w JOIN orders ON o_custkey = w.set_id
   WHERE code IN ('COURSE_CATEGORY_MISMATCH', 'COURSE_RECORD_CONTRADICTION', 'COURSE_NOT_IN_RULE_CATALOG')
 UNION ALL SELECT set_id, w.rule_set_id, w.code, 'cat-' || w.rule_set_id || '-' || category FROM w JOIN cats USING (rule_set_id) WHERE w.code = 'REQUIRED_COURSE_UNKNOWN'
 UNION ALL SELECT set_id, rule_set_id, code, 'head-' || rule_set_id FROM w WHERE code = 'DEGREE_PLAN_VERSION_CONFLICT'))
SELECT rule_set_id, code, count(*) AS n_links, count(DISTINCT chunk_id) AS n_chunks FROM ev GROUP BY ALL""",
)
def plan_warning_evidence(t: Tables) -> DataFrame:
    i = Inputs(t)
    record_chunks = t.orders.select(F.col("o_custkey").alias("set_id"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    head = i.rule_sets.select("rule_set_id", F.lit("header").alias("kind"), F.lit("").alias("item"), F.concat(F.lit("head-"), "rule_set_id").alias("chunk_id"))
    cats = i.categories.select(
        "rule_set_id", F.lit("category").alias("kind"), F.col("category").alias("item"), F.concat_ws("-", F.lit("cat"), "rule_set_id", "category").alias("chunk_id")
    )
    links = au.warning_evidence(i.items(), record_chunks, head.unionByName(cats))
    return links.groupBy("rule_set_id", "code").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("chunk_id").alias("n_chunks"))


@query(
    "plan_missing_evidence", "A25",
    f"""WITH {AUDIT_SQL} SELECT mis.set_id, mis.rule_set_id, mis.code AS course_code,
CASE WHEN NOT unknown THEN 'row-' || mis.code ELSE 'head-' || mis.rule_set_id END AS chunk_id FROM mis""",
)
def plan_missing_evidence(t: Tables) -> DataFrame:
    i = Inputs(t)
    head = i.rule_sets.select("rule_set_id", F.lit("header").alias("kind"), F.lit("").alias("item"), F.concat(F.lit("head-"), "rule_set_id").alias("chunk_id"))
    rows = i.catalog.select(
        "rule_set_id", F.lit("course").alias("kind"), F.col("course_code").alias("item"), F.concat(F.lit("row-"), "course_code").alias("chunk_id")
    )
    return au.missing_evidence(i.missing(), head.unionByName(rows))


@query(
    "plan_assembly", "A26",
    f"""WITH {AUDIT_SQL}, g AS (SELECT set_id, rule_set_id, string_agg(category || '=' || remaining, ',' ORDER BY ordinal) AS gaps FROM gap GROUP BY ALL),
m AS (SELECT set_id, rule_set_id, count(*) AS n_missing, string_agg(code, ',' ORDER BY ordinal, position) AS missing FROM mis GROUP BY ALL),
w AS (SELECT set_id, rule_set_id, string_agg(code, ',' ORDER BY ordinal) AS warning_codes FROM (SELECT DISTINCT set_id, rule_set_id, ordinal, code FROM wi) GROUP BY ALL)
SELECT tot.set_id, tot.rule_set_id, required, completed, in_progress, remaining, gaps, coalesce(n_missing, 0)::INT AS n_missing, coalesce(missing, '') AS missing,
coalesce(warning_codes, '') AS warning_codes FROM tot LEFT JOIN g USING (set_id, rule_set_id) LEFT JOIN m USING (set_id, rule_set_id) LEFT JOIN w USING (set_id, rule_set_id)""",
)
def plan_assembly(t: Tables) -> DataFrame:
    plan = Inputs(t).plans()
    none = F.array().cast("array<string>")
    return plan.select(
        *au.KEY, "required", "completed", "in_progress", "remaining",
        F.array_join(F.transform("gaps", lambda g: F.concat_ws("=", g["category"], g["remaining"].cast("string"))), ",").alias("gaps"),
        F.coalesce(F.size("missing"), F.lit(0)).alias("n_missing"),
        F.array_join(F.coalesce(F.transform("missing", lambda m: m["course_code"]), none), ",").alias("missing"),
        F.array_join(F.coalesce("warning_codes", none), ",").alias("warning_codes"),
    )


@query(
    "plan_invariants", "A27",
    f"""WITH {AUDIT_SQL}, g AS (SELECT set_id, rule_set_id, sum(completed) AS c, sum(in_progress) AS o,
 bool_and(remaining = greatest(required - completed - in_progress, 0)::DECIMAL(12,1)) AS gaps_ok FROM gap GROUP BY ALL)
SELECT set_id, rule_set_id, completed >= 0 AND in_progress >= 0 AND required >= 0 AS non_negative,
 remaining = greatest(required - completed - in_progress, 0)::DECIMAL(12,1) AS remaining_ok, g.c = completed AS completed_ok, g.o = in_progress AS in_progress_ok, gaps_ok
FROM tot JOIN g USING (set_id, rule_set_id)""",
)
def plan_invariants(t: Tables) -> DataFrame:
    i = Inputs(t)
    return au.plan_invariants(i.totals(), i.gaps())


@query(
    "plan_diff", "A28",
    f"""WITH {AUDIT_SQL}, full_ AS (SELECT set_id, rule_version, tot.required, completed, in_progress, remaining,
  (SELECT string_agg(code || name || credits || category, ',' ORDER BY ordinal, position) FROM mis WHERE mis.set_id = tot.set_id AND mis.rule_set_id = tot.rule_set_id) AS missing,
  (SELECT string_agg(ordinal || ':' || required || ':' || completed || ':' || in_progress || ':' || remaining, ',' ORDER BY ordinal) FROM gap WHERE gap.set_id = tot.set_id AND gap.rule_set_id = tot.rule_set_id) AS gaps,
  coalesce((SELECT string_agg(code, ',' ORDER BY ordinal) || ',' FROM (SELECT DISTINCT set_id, rule_set_id, ordinal, code FROM wi) w WHERE w.set_id = tot.set_id AND w.rule_set_id = tot.rule_set_id), '') AS codes
  FROM tot JOIN rs USING (rule_set_id))
SELECT p.set_id, p.required IS DISTINCT FROM e.required AS required_differs, p.completed IS DISTINCT FROM e.completed AS completed_differs,
p.in_progress IS DISTINCT FROM e.in_progress AS in_progress_differs, p.remaining IS DISTINCT FROM e.remaining AS remaining_differs,
p.missing IS DISTINCT FROM e.missing AS missing_differs, p.gaps IS DISTINCT FROM e.gaps AS gaps_differs, NOT starts_with(p.codes, e.codes) AS warnings_differ
FROM full_ p JOIN full_ e ON p.set_id = e.set_id AND p.rule_version = '2025.1' AND e.rule_version = '2026.1'""",
)
def plan_diff(t: Tables) -> DataFrame:
    """The plans of the two rule versions against each other."""
    plan = Inputs(t).plans()
    side = [plan.where(F.endswith("rule_set_id", F.lit(v))).drop("rule_set_id") for v in VERSIONS]
    return au.plan_diff(side[0], side[1], ["set_id"])


# --- values and projections ----------------------------------------------------------

@query(
    "credit_validation", "A1",
    """WITH v AS (SELECT p_partkey, CASE WHEN p_size > 48 THEN 'NaN' WHEN p_size > 46 THEN '-' || p_size WHEN p_size > 44 THEN 'about ' || p_size
 WHEN p_size > 42 THEN NULL WHEN p_size > 40 THEN ' ' || p_size || '.25 ' ELSE p_retailprice::VARCHAR END AS raw FROM part)
SELECT p_partkey, CASE WHEN p_partkey IS NULL THEN '' WHEN raw IS NULL OR raw = 'NaN' OR starts_with(raw, 'about') THEN 'not_a_number' WHEN starts_with(raw, '-') THEN 'negative'
 WHEN trim(raw)::DOUBLE > 999.9 THEN 'out_of_range' END AS error,
CASE WHEN raw IS NULL OR raw = 'NaN' OR starts_with(raw, 'about') OR starts_with(raw, '-') OR try_cast(trim(raw) AS DOUBLE) > 999.9 THEN NULL ELSE round(trim(raw)::DECIMAL(10,4), 1)::DECIMAL(12,1) END AS credit FROM v""",
)
def credit_validation(t: Tables) -> DataFrame:
    size = F.col("p_size")
    raw = (
        F.when(size > 48, "NaN").when(size > 46, F.concat(F.lit("-"), size.cast("string"))).when(size > 44, F.concat(F.lit("about "), size.cast("string")))
        .when(size > 42, None).when(size > 40, F.concat(F.lit(" "), size.cast("string"), F.lit(".25 "))).otherwise(F.col("p_retailprice").cast("string"))
    )
    return t.part.select("p_partkey", au.to_credit(raw).alias("c")).select(
        "p_partkey", F.col("c.error").alias("error"), au.quantise(F.col("c.value")).alias("credit")
    )


@query(
    "status_normalise", "A2",
    """SELECT l_returnflag, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'N' THEN 'in_progress' WHEN 'R' THEN CASE l_linestatus WHEN 'O' THEN 'failed' END END AS status,
count(*) AS n FROM lineitem GROUP BY ALL""",
)
def status_normalise(t: Tables) -> DataFrame:
    raw = (
        F.when(F.col("l_returnflag") == "A", " 已通过").when(F.col("l_returnflag") == "N", "in_progress")
        .when(F.col("l_linestatus") == "O", "挂科").otherwise("unclear")
    )
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", au.norm_status(raw).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _record_text(f: dict) -> Column:
    parts = []
    for i, (label, value) in enumerate(f.items()):
        parts += [F.lit(("；" if i else "") + label + ": "), value]
    return F.concat(*parts)


@query(
    "project_records", "A3,P12",
    """WITH r AS (SELECT o_custkey AS set_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
  CASE WHEN l_tax >= 0.08 AND l_quantity = 50 THEN 'unknown_status' WHEN l_quantity = 49 AND l_tax >= 0.08 THEN 'missing_label' END AS row_error
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT set_id, arg_min(row_error, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (row_error IS NOT NULL) AS set_error, count(*) AS n_rows FROM r GROUP BY set_id)
SELECT set_id, CASE WHEN set_id % 10 = 0 THEN 'missing_columns' ELSE set_error END AS set_error, n_rows, round(total, 1)::DECIMAL(12,1) AS total_credits
FROM s JOIN (SELECT set_id, sum(CASE WHEN row_error = 'missing_label' THEN NULL ELSE round(l_quantity / 10, 1)::DECIMAL(10,4) END) AS total FROM r GROUP BY set_id) USING (set_id)""",
)
def project_records(t: Tables) -> DataFrame:
    li = t.wide("lineitem").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("set_id")), "l_orderkey")
    heavy = F.col("l_tax") >= 0.08
    status = (
        F.when(heavy & (F.col("l_quantity") == 50), "?").when(F.col("l_returnflag") == "A", "通过")
        .when(F.col("l_returnflag") == "N", "在修").otherwise("未通过")
    )
    code = F.concat(F.lit("QM-P"), F.col("l_partkey").cast("string"))
    head = _record_text({"课程代码": code, "课程名称": F.lit("part"), "状态": status})
    body = F.when(heavy & (F.col("l_quantity") == 49), head).otherwise(
        F.concat(head, _record_text({"；学分": F.round(F.col("l_quantity") / 10, 1).cast("string"), "课程类别": F.col("l_linestatus")}))
    )
    rows = li.select(
        "set_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("block_index"),
        F.lit("table_row").alias("block_type"), body.alias("text"),
    )
    zero = F.struct(
        F.lit(-1).cast("bigint").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(0).cast("bigint").alias("l_partkey"), F.lit(0).cast("bigint").alias("l_suppkey")
    )
    headers = li.select("set_id").distinct().select(
        "set_id", zero.alias("block_index"), F.lit("table_header").alias("block_type"),
        F.when(F.col("set_id") % 10 == 0, "课程代码 | 学分").otherwise("课程代码 | 课程名称 | 学分 | 课程类别 | 状态 | 成绩").alias("text"),
    )
    return au.project_records(rows.unionByName(headers)).groupBy("set_id").agg(
        F.first("set_error").alias("set_error"), F.count("block_index").alias("n_rows"), au.quantise(F.sum("credits")).alias("total_credits")
    )


@query(
    "project_table", "A4",
    """SELECT l_suppkey AS table_id, l_partkey::VARCHAR AS course_code, count(*) AS n,
 CASE WHEN l_suppkey % 7 = 0 THEN 'missing_columns' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'unknown_status' END AS error,
 CASE WHEN l_linenumber = 3 THEN '未分类' ELSE l_linestatus END AS category FROM lineitem GROUP BY ALL""",
)
def project_table(t: Tables) -> DataFrame:
    names = F.when(F.col("l_suppkey") % 7 == 0, F.array(*[F.lit(x) for x in ("课程编号", "课程名称", "学分", "课程类别", "备注")])).otherwise(
        F.array(*[F.lit(x) for x in ("课程编号", "课程名称", "学分", "类别", "修读状态", "课程代码")])
    )
    headers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey")).select(F.col("l_suppkey").alias("table_id"), names.alias("header"))
    status = F.when(F.col("l_returnflag") == "A", "通过").when(F.col("l_returnflag") == "N", "在修").when(F.col("l_linestatus") == "O", "失败").otherwise("?")
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("table_id"), "l_linenumber",
        F.array(
            F.col("l_partkey").cast("string"), F.lit(" "), F.lit("2.5"), F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_linestatus")), status,
        ).alias("cells"),
    ).withColumnRenamed("l_linenumber", "row_no")
    return au.project_table(headers, rows).groupBy("table_id", "course_code", "error", "category").agg(F.count(F.lit(1)).alias("n"))


def rule_blocks(t: Tables) -> DataFrame:
    """One rule document per brand: label rows, a total, category lines, catalogue rows of both shapes."""
    doc = F.col("p_brand").alias("doc_id")
    brands = t.part.select("p_brand").distinct()

    def fixed(no: int, text) -> Column:
        return F.struct(F.lit(no).cast("bigint").alias("block_index"), text.alias("text"))

    heads = [
        fixed(0, F.concat(F.lit("专业名称："), "p_brand", F.lit("；招生年份：2025年；文档版本：2025.1；生效日期：2025-09-01"))),
        fixed(1, F.lit("毕业总学分：155.0 学分")),
    ] + [
        fixed(2 + i, F.lit(f"· {name}必修：{5 + i}.0 学分" if i % 2 else f"课程类别: {name}必修；最低学分: {5 + i}.0 学分"))
        for i, name in enumerate(TYPES[:5])
    ] + [fixed(7, F.lit("· ECONOMY必修：5.0 学分")), fixed(8, F.when(F.col("p_brand") < "Brand#2", F.lit("· LARGE必修：9.9 学分")).otherwise(F.lit("说明文字")))]
    top = brands.select(doc, F.explode(F.array(*heads)).alias("b")).select("doc_id", "b.*")
    code = F.concat(F.lit("QM-CS"), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    credit = F.format_string("%.1f", F.col("p_size") / 10)
    line = F.concat_ws(" ", code, F.col("p_name"), credit, F.concat("p_type", F.lit("必修")), F.lit("第1学期 无"))
    table = _record_text({"课程代码": code, "课程名称": F.col("p_name"), "学分": credit, "课程类别": F.concat("p_type", F.lit("必修"))})
    rows = t.part.select(doc, (F.col("p_partkey") + 10).alias("block_index"), F.when(F.col("p_size") > 25, line).otherwise(table).alias("text"))
    return top.unionByName(rows)


RULE_SQL = """
ent AS (SELECT p_brand AS doc_id, p_partkey, 'QM-CS' || printf('%03d', p_size) AS code, p_name AS name, round(p_size / 10, 1)::DECIMAL(10,4) AS credits, p_type || '必修' AS category
  FROM part WHERE p_size <= 25 OR p_type <> 'STANDARD'),
grp AS (SELECT doc_id, code, count(*) AS n, arg_min(name, p_partkey) AS name, arg_min(credits, p_partkey) AS credits, arg_min(category, p_partkey) AS category,
  count(DISTINCT (name, credits, category)) AS d FROM ent GROUP BY ALL)"""


@query(
    "project_rule_catalog", "A5,A6",
    f"""WITH {RULE_SQL} SELECT doc_id, code AS course_code, name AS course_name, credits, category, n,
CASE WHEN n = 1 THEN 'unique' WHEN d = 1 THEN 'repeated' ELSE 'conflicting' END AS outcome FROM grp""",
)
def project_rule_catalog(t: Tables) -> DataFrame:
    return au.project_rules(rule_blocks(t))["catalog"].drop("block_index")


@query(
    "project_rule_header", "A5",
    """SELECT DISTINCT p_brand AS doc_id, p_brand AS major, 2025 AS admission_year, '2025.1' AS rule_version, '2025-09-01' AS effective_from, 155::DECIMAL(10,4) AS required_credits FROM part""",
)
def project_rule_header(t: Tables) -> DataFrame:
    return au.project_rules(rule_blocks(t))["header"]


@query(
    "rule_duplicates", "A6",
    f"""WITH {RULE_SQL}, b AS (SELECT DISTINCT p_brand AS doc_id FROM part)
SELECT doc_id, 'catalog_' || CASE WHEN d = 1 THEN 'repeated' ELSE 'conflicting' END AS issue, code AS item FROM grp WHERE n > 1
UNION ALL SELECT doc_id, 'category_undeclared', code FROM grp WHERE category = 'STANDARD必修'
UNION ALL SELECT doc_id, 'category_repeated', 'ECONOMY必修' FROM b
UNION ALL SELECT doc_id, 'category_conflicting', 'LARGE必修' FROM b WHERE doc_id < 'Brand#2'""",
)
def rule_duplicates(t: Tables) -> DataFrame:
    return au.project_rules(rule_blocks(t))["issues"]


@query(
    "rule_required_codes", "A7",
    f"WITH {RULE_SQL} SELECT doc_id, category, code AS course_code FROM grp",
)
def rule_required_codes(t: Tables) -> DataFrame:
    return au.required_codes(au.project_rules(rule_blocks(t))["catalog"])


_FP = "sum(CAST('0x' || substr(sha256({}), 1, 15) AS UBIGINT)::HUGEINT)::VARCHAR"


@query(
    "set_fingerprints", "A8",
    f"""SELECT o_custkey AS set_id, count(*) AS n_rows,
{_FP.format("o_orderkey || chr(31) || o_orderstatus || chr(31) || o_orderpriority")} AS fingerprint FROM orders GROUP BY o_custkey""",
)
def set_fingerprints(t: Tables) -> DataFrame:
    return au.set_fingerprints(
        t.orders.withColumnRenamed("o_custkey", "set_id"), "set_id", F.col("o_orderkey"), [F.col("o_orderstatus"), F.col("o_orderpriority")]
    )


@query(
    "projection_upsert", "A9",
    """SELECT 'upload' AS source_type, c_custkey AS source_key, c_mktsegment AS dataset_version, c_nationkey::VARCHAR AS fingerprint,
CASE WHEN c_acctbal < 0 THEN 'insert' WHEN c_nationkey < 12 THEN 'skip' ELSE 'replace' END AS action FROM customer""",
)
def projection_upsert(t: Tables) -> DataFrame:
    c = t.customer.select(
        F.lit("upload").alias("source_type"), F.col("c_custkey").alias("source_key"), F.col("c_mktsegment").alias("dataset_version"),
        F.col("c_nationkey").cast("string").alias("fingerprint"), "c_acctbal", "c_nationkey",
    )
    old = c.where(~(F.col("c_acctbal") < 0)).withColumn("fingerprint", F.least(F.col("c_nationkey"), F.lit(11)).cast("string"))
    return au.upsert_actions(c.drop("c_acctbal", "c_nationkey"), old)


@query(
    "activation_sync", "A9",
    """WITH v AS (SELECT min(o_orderstatus) AS v FROM orders)
SELECT o_orderkey AS set_id, CASE WHEN month(o_orderdate) <= 6 THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'active' END
 WHEN o_orderstatus = v THEN 'active' ELSE 'inactive' END AS activation_state FROM orders, v""",
)
def activation_sync(t: Tables) -> DataFrame:
    sets = t.orders.select(
        F.col("o_orderkey").alias("set_id"), F.col("o_orderstatus").alias("dataset_version"),
        F.when(F.month("o_orderdate") <= 6, "upload").otherwise("demo").alias("source_type"),
        F.when(F.col("o_orderpriority") == "5-LOW", "active").alias("activation_state"),
    )
    version = t.orders.agg(F.min("o_orderstatus")).scalar()
    return au.sync_activation(sets, version).select("set_id", "activation_state")


@query(
    "selectable_sets", "A10",
    """WITH v AS (SELECT min(o_orderstatus) AS v FROM orders)
SELECT o_orderkey AS set_id, o_custkey AS source_doc_id FROM orders, v WHERE o_orderpriority <> '5-LOW'
AND (month(o_orderdate) <= 6 OR o_orderstatus = v) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def selectable_sets(t: Tables) -> DataFrame:
    sets = t.orders.select(
        F.col("o_orderkey").alias("set_id"), F.col("o_custkey").alias("source_doc_id"), F.col("o_orderstatus").alias("dataset_version"),
        F.when(F.month("o_orderdate") <= 6, "upload").otherwise("demo").alias("source_type"),
        F.when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("ready").alias("status"),
    )
    docs = t.customer.select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") < 0).alias("deleted"))
    pointer = t.orders.agg(F.min("o_orderstatus").alias("dataset_version"))
    return au.selectable_sets(sets, docs, pointer).select("set_id", "source_doc_id")


@query(
    "rule_versions", "A17",
    f"""WITH {AUDIT_SQL} SELECT a.rule_set_id, a.major, a.rule_version, b.rule_version AS other FROM rs a JOIN rs b ON a.major = b.major AND a.rule_version <> b.rule_version""",
)
def rule_versions(t: Tables) -> DataFrame:
    return au.other_versions(Inputs(t).rule_sets).select("rule_set_id", "major", "rule_version", F.explode("others").alias("other"))


# --- time -----------------------------------------------------------------------------

_DAY = "(['一','二','三','四','五','六','日'])[isodow(ts)]"


def slot_records(t: Tables, unit: str) -> DataFrame:
    """Events as in-progress records of a user; schedule and term are rendered as text."""
    e = t.wide("events")
    day = F.element_at(F.array(*[F.lit(x) for x in "一二三四五六日"]), (F.weekday("ts") + 1))
    minute = F.hour("ts") * 60 + F.minute("ts")
    stop = F.least(minute + 1 + (F.floor("value") % 120).cast("int"), F.lit(1439))
    clock = F.concat(
        F.lit("星期"), day, F.lit(" "), F.format_string("%d:%02d", F.hour("ts"), F.minute("ts")), F.lit("-"),
        F.format_string("%d:%02d", F.floor(stop / 60), stop % 60),
    )
    first = F.hour("ts") + 1
    period = F.concat(F.lit("星期"), day, F.lit("第"), first.cast("string"), F.lit("-"), (first + F.floor("value") % 3).cast("string"), F.lit("节"))
    return e.select(
        F.col("user_id").alias("set_id"), F.concat(F.year("ts").cast("string"), F.lit("-2025 学年第一学期")).alias("semester"),
        F.col("event_type").alias("course_code"), F.lit("in_progress").alias("status"), (clock if unit == "clock" else period).alias("schedule"),
    )


@query(
    "schedule_overlap_clock", "A18,A19,A20",
    """WITH s AS (SELECT user_id, event_type AS code, isodow(ts) AS d, hour(ts) * 60 + minute(ts) AS a, least(hour(ts) * 60 + minute(ts) + 1 + floor(value)::BIGINT % 120, 1439) AS b FROM events)
SELECT DISTINCT l.user_id AS set_id, l.code AS left_code, r.code AS right_code FROM s l JOIN s r ON l.user_id = r.user_id AND l.d = r.d AND l.code < r.code AND l.a < r.b AND r.a < l.b
WHERE l.a <= l.b AND r.a <= r.b""",
)
def schedule_overlap_clock(t: Tables) -> DataFrame:
    return au.schedule_conflicts(au.schedule_slots(slot_records(t, "clock")))


CLOCK_SQL = """sl AS (SELECT user_id, event_type AS code, isodow(ts) AS d, hour(ts) * 60 + minute(ts) AS a, least(hour(ts) * 60 + minute(ts) + 1 + floor(value)::BIGINT % 120, 1439) AS b FROM events),
tc AS (SELECT DISTINCT l.user_id AS set_id, l.code || '|' || r.code AS item FROM sl l JOIN sl r ON l.user_id = r.user_id AND l.d = r.d AND l.code < r.code AND l.a < r.b AND r.a < l.b
 WHERE l.a <= l.b AND r.a <= r.b)"""


@query(
    "plan_time_warnings", "A20,A24,A26",
    f"""WITH {AUDIT_SQL}, {CLOCK_SQL}, both_ AS (SELECT set_id, rule_set_id, ordinal, code, item FROM wi
 UNION ALL SELECT tot.set_id, tot.rule_set_id, 1, '{au.WARNINGS[1]}', item FROM tc JOIN tot ON tot.set_id = tc.set_id)
SELECT set_id, rule_set_id, ordinal::INT AS ordinal, code, count(*) AS n_items, min(item) AS first_item, max(item) AS last_item FROM both_ GROUP BY ALL""",
)
def plan_time_warnings(t: Tables) -> DataFrame:
    """Warnings of a plan with the time conflicts of its set's schedule among them."""
    conflicts = au.schedule_conflicts(au.schedule_slots(slot_records(t, "clock")))
    return au.warnings(Inputs(t).items(au.time_items(conflicts)))


@query(
    "schedule_overlap_period", "A18,A19,A20",
    """WITH s AS (SELECT user_id, event_type AS code, isodow(ts) AS d, hour(ts) + 1 AS a, hour(ts) + 1 + floor(value)::BIGINT % 3 AS b FROM events)
SELECT DISTINCT l.user_id AS set_id, l.code AS left_code, r.code AS right_code FROM s l JOIN s r ON l.user_id = r.user_id AND l.d = r.d AND l.code < r.code AND l.a <= r.b AND r.a <= l.b""",
)
def schedule_overlap_period(t: Tables) -> DataFrame:
    return au.schedule_conflicts(au.schedule_slots(slot_records(t, "period")))


@query(
    "timetable_conflicts", "A21",
    """WITH c AS (SELECT DISTINCT l_suppkey AS doc_id, year(l_shipdate) AS term, isodow(l_shipdate) - 1 AS weekday, l_linenumber AS period, l_partkey AS code FROM lineitem),
k AS (SELECT doc_id, term, weekday, period, count(*) AS n_codes FROM c GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT DISTINCT o_custkey AS set_id, year(l_shipdate) AS term, l_partkey AS code FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'N')
SELECT DISTINCT set_id, c.doc_id, c.term::INT AS term, c.weekday::INT AS weekday, c.period, n_codes FROM c JOIN p ON c.term = p.term AND c.code = p.code
JOIN k ON k.doc_id = c.doc_id AND k.term = c.term AND k.weekday = c.weekday AND k.period = c.period""",
)
def timetable_conflicts(t: Tables) -> DataFrame:
    li = t.lineitem
    term = F.year("l_shipdate")
    table = li.select(
        F.col("l_suppkey").alias("doc_id"), term.alias("term"), F.weekday("l_shipdate").alias("weekday"),
        F.col("l_linenumber").alias("period"), F.col("l_partkey").alias("course_code"),
    )
    taking = li.where("l_returnflag = 'N'").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("set_id"), term.alias("term"), F.col("l_partkey").alias("course_code")
    )
    return au.timetable_conflicts(table, taking)


@query(
    "narrowest_cover", "A22",
    """WITH c AS (SELECT l_orderkey AS doc_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS chunk_id, l_linenumber AS chunk_index, l_linenumber AS a, l_linenumber + floor(l_quantity / 8)::INT AS b FROM lineitem),
t AS (SELECT o_orderkey AS target_id, month(o_orderdate)::INT AS a, month(o_orderdate)::INT + CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS b FROM orders),
h AS (SELECT target_id, chunk_id, c.b - c.a AS span, c.a = t.a AND c.b = t.b AS exact, row_number() OVER (PARTITION BY target_id ORDER BY (c.a = t.a AND c.b = t.b) DESC, c.b - c.a, chunk_index, chunk_id) AS r
  FROM t JOIN c ON c.doc_id = target_id AND c.a <= t.a AND c.b >= t.b)
SELECT t.target_id, chunk_id, span::INT AS span, exact FROM t LEFT JOIN h ON h.target_id = t.target_id AND r = 1""",
)
def narrowest_cover(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    chunks = t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), line.cast("string")).alias("chunk_id"),
        line.alias("chunk_index"), line.alias("start"), (line + F.floor(F.col("l_quantity") / 8).cast("int")).alias("end"),
    )
    start = F.month("o_orderdate")
    targets = t.orders.select(
        F.col("o_orderkey").alias("target_id"), F.col("o_orderkey").alias("doc_id"), start.alias("start"),
        (start + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("end"),
    )
    return au.narrowest_cover(targets, chunks)


@query(
    "evidence_check", "A23",
    """SELECT o_orderkey::VARCHAR AS chunk_id, o_custkey AS doc_id, CASE WHEN c_custkey IS NULL THEN 'chunk_missing' WHEN o_orderstatus = 'P' THEN 'doc_mismatch'
WHEN c_nationkey < 5 AND c_acctbal < 0 THEN 'locator_incomplete' WHEN c_nationkey >= 5 AND c_acctbal < -500 THEN 'locator_incomplete' END AS reason
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey""",
)
def evidence_check(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), "o_orderstatus")
    c = t.customer.where("c_mktsegment <> 'BUILDING'")
    bal = F.col("c_acctbal")
    locator = F.struct(
        F.when(bal >= -500, 1).alias("page_number"), F.lit("sheet").alias("sheet_name"), F.lit(2).alias("row_start"),
        F.when(bal < 0, 1).otherwise(2).alias("row_end"), F.lit(None).cast("string").alias("section_title"),
    )
    chunks = o.join(c, F.col("c_custkey") == F.col("doc_id")).select(
        "chunk_id", F.when(F.col("o_orderstatus") == "P", -1).otherwise(F.col("doc_id")).alias("owner"),
        F.when(F.col("c_nationkey") < 5, "xlsx").otherwise("pdf").alias("file_type"), locator.alias("locator"),
    )
    return au.load_evidence(o, chunks)
