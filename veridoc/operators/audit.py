"""Requirement audit: records x rules x catalogue -> credits, gaps, missing items, warnings.

Everything is computed for all (record_set, rule_set) pairs at once. Records collapse to one
row per (set, course) with combinable aggregates before any rule is joined. Records, pairs, catalogue
and chunks grow with the input, so their joins are shuffled (``shuffled``); rule sets, categories and required courses, the rule definitions, are broadcast.

Tables: records (set_id, ordinal, course_code, credits, category, status, semester, schedule),
pairs (set_id, rule_set_id), rule_sets (rule_set_id, major, rule_version, required_credits),
categories (rule_set_id, ordinal, category, minimum_credits), required (rule_set_id,
ordinal, category, position, course_code), catalog (rule_set_id, course_code, course_name,
credits, category).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions import text as tx
from veridoc.functions.digest import sha256
from veridoc.session import shuffled, stored

# --- fixed values -----------------------------------------------------------
MAX_CREDIT = "999.9"
RECORD_LABELS = ("课程代码", "课程名称", "学分", "课程类别", "状态")
RULE_LABELS = ("专业名称", "招生年份", "文档版本", "生效日期")
RULE_FIELDS = ("major", "admission_year", "rule_version", "effective_from")
CATEGORY_LABELS = ("课程类别", "类别")
MINIMUM_LABELS = ("最低学分", "最低毕业学分", "最低修读学分", "学分")
TOTAL_LABEL = "毕业总学分"
REQUIRED_SUFFIX = "必修"
NO_CATEGORY = "未分类"
STATUSES = ("passed", "in_progress", "failed")
STATUS_ALIASES = {
    "通过": "passed", "已通过": "passed", "已修": "passed", "已修读": "passed", "及格": "passed",
    "在修": "in_progress", "在修读": "in_progress", "修读中": "in_progress", "进行中": "in_progress",
    "未通过": "failed", "不及格": "failed", "未及格": "failed", "挂科": "failed", "失败": "failed",
}
COLUMN_ALIASES = {
    "课程代码": "course_code", "课程编号": "course_code", "课程名称": "course_name", "学分": "credits",
    "课程类别": "category", "类别": "category", "成绩": "grade", "分数": "grade", "状态": "status",
    "修读状态": "status", "学期": "semester", "上课时间": "schedule", "时间": "schedule",
}
WARNINGS = (
    "DEGREE_PLAN_VERSION_CONFLICT", "COURSE_TIME_CONFLICT", "COURSE_CATEGORY_MISMATCH",
    "COURSE_RECORD_CONTRADICTION", "COURSE_NOT_IN_RULE_CATALOG", "REQUIRED_COURSE_UNKNOWN",
)
COURSE_CODE = r"^[A-Za-z]{2,5}-[A-Za-z]{2,5}\d{2,5}$"
# --- end of fixed values ----------------------------------------------------
KEY = ["set_id", "rule_set_id"]
CREDIT = "decimal(10,4)"
GAPS = f"array<struct<ordinal:int,category:string,required:{CREDIT},completed:decimal(12,1),in_progress:decimal(12,1),remaining:decimal(12,1)>>"


# --- values (A1, A2) -----------------------------------------------------------

def to_credit(c: Column) -> Column:
    """struct(value, error) from text: finite, not negative, at most 999.9."""
    text = tx.strip_ws(c.cast("string"))
    number = text.try_cast("double")
    value = text.try_cast("decimal(20,4)")
    error = (
        F.when(number.isNull() | F.isnan(number) | text.rlike(r"(?i)[fdL]$"), "not_a_number")
        .when(F.abs(number) == F.lit(float("inf")), "not_finite")
        .when(number < 0, "negative")
        .when((number > 1e9) | (value > F.lit(MAX_CREDIT).cast("decimal(20,4)")), "out_of_range")
    )
    return F.struct(F.when(error.isNull(), value.cast(CREDIT)).alias("value"), error.alias("error"))


def quantise(c: Column) -> Column:
    """One decimal, half up."""
    return F.round(c, 1).cast("decimal(12,1)")


def norm_status(c: Column) -> Column:
    """Alias or canonical status; null when unknown."""
    text = tx.strip_ws(c)
    known = F.create_map(*[F.lit(x) for pair in STATUS_ALIASES.items() for x in pair])
    return F.when(text.isin(*STATUSES), text).otherwise(F.try_element_at(known, text))


# --- projections (A3-A9) --------------------------------------------------------

def project_records(blocks: DataFrame) -> DataFrame:
    """Blocks (set_id, block_index, block_type, text) -> record rows with set-level rejection.

    A set is rejected when its headers miss a label, a coded row misses one, a status or a
    credit is invalid, or no record remains. ``set_error`` names the first of these.
    """
    pairs = labelled_map(F.col("text"))
    rows = blocks.where("block_type = 'table_row'").select("set_id", "block_index", pairs.alias("m")).where(
        F.map_contains_key("m", F.lit(RECORD_LABELS[0]))
    )

    def value(label: str) -> Column:
        return F.try_element_at("m", F.lit(label))

    absent = F.exists(F.array(*[F.map_contains_key("m", F.lit(x)) for x in RECORD_LABELS]), lambda b: ~b)
    credit = to_credit(value("学分"))
    status = norm_status(value("状态"))
    rows = rows.select(
        "set_id", "block_index", value("课程代码").alias("course_code"), value("课程名称").alias("course_name"),
        credit.getField("value").alias("credits"), value("课程类别").alias("category"), status.alias("status"),
        F.nullif(value("学期"), F.lit("")).alias("semester"), F.nullif(value("上课时间"), F.lit("")).alias("schedule"),
        F.when(absent, "missing_label").when(status.isNull(), "unknown_status")
        .when(credit.getField("error").isNotNull(), "invalid_credit").alias("row_error"),
    )
    # the parsed rows feed the verdict and the result: one exchange keeps them from being parsed twice
    rows = rows.repartition("set_id", "block_index")
    labels = (
        blocks.where("block_type = 'table_header'")
        .select("set_id", F.explode(F.transform(F.split("text", r"\|"), tx.strip_ws)).alias("label"))
        .where(F.col("label").isin(*RECORD_LABELS))
        .groupBy("set_id").agg(F.count_distinct("label").alias("n_labels"))
    )
    verdict = (
        blocks.select("set_id").distinct()
        .join(labels, "set_id", "left")
        .join(
            rows.groupBy("set_id").agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.min_by("row_error", F.when(F.col("row_error").isNotNull(), F.col("block_index"))).alias("first_error"),
            ),
            "set_id", "left",
        )
        .select(
            "set_id",
            F.when(F.coalesce("n_labels", F.lit(0)) < len(RECORD_LABELS), "missing_columns")
            .when(F.col("first_error").isNotNull(), F.col("first_error"))
            .when(F.coalesce("n_rows", F.lit(0)) == 0, "no_records").alias("set_error"),
        )
    )
    return rows.join(verdict, "set_id", "right")


def labelled_map(c: Column) -> Column:
    """``label: value`` pairs of one text; segments when there are two or more, else a scan."""
    pattern = r"(?U)([^\s：:；;]{1,20})[：:]\s*([^\s：:；;]+)"

    def pairs(text: Column) -> Column:
        several = text.rlike(r"(?sU)[^\s；;].*[；;].*[^\s；;]")
        scan = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda hit: F.struct(
                F.regexp_extract(hit, pattern, 1).alias("key"), F.regexp_extract(hit, pattern, 2).alias("value")
            ),
        )
        return tx.let(tx.segment_pairs(text), lambda seg: F.when(several & (F.size(seg) > 0), seg).otherwise(scan))

    return tx.first_wins_map(tx.let(F.coalesce(c, F.lit("")), pairs))


def column_positions(headers: DataFrame) -> DataFrame:
    """(table_id, header array) -> one position (0-based) per canonical field; first alias wins."""
    known = F.create_map(*[F.lit(x) for pair in COLUMN_ALIASES.items() for x in pair])
    cells = headers.select("table_id", F.posexplode("header").alias("position", "label"))
    return (
        cells.withColumn("field", F.try_element_at(known, tx.strip_ws(F.coalesce("label", F.lit("")))))
        .where("field IS NOT NULL")
        .groupBy("table_id", "field").agg(F.min("position").alias("position"))
    )


def project_table(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Header plus cell rows -> records; columns are chosen by alias, blanks get their default."""
    at = column_positions(headers).groupBy("table_id").pivot(
        "field", ["course_code", "course_name", "credits", "category", "grade", "status", "semester", "schedule"]
    ).agg(F.min("position"))
    j = rows.join(at, "table_id").where(F.exists("cells", lambda c: tx.strip_ws(F.coalesce(c, F.lit(""))) != ""))

    def cell(field: str) -> Column:
        return F.coalesce(tx.strip_ws(F.get("cells", F.col(field))), F.lit(""))

    code = cell("course_code")
    credit = to_credit(cell("credits"))
    status = norm_status(cell("status"))
    missing = F.greatest(*[F.col(f).isNull().cast("int") for f in ("course_code", "course_name", "credits", "category", "status")])
    return j.select(
        "table_id", "row_no", code.alias("course_code"),
        F.coalesce(F.nullif(cell("course_name"), F.lit("")), code).alias("course_name"),
        credit.getField("value").alias("credits"),
        F.coalesce(F.nullif(cell("category"), F.lit("")), F.lit(NO_CATEGORY)).alias("category"),
        F.nullif(cell("grade"), F.lit("")).alias("grade"), status.alias("status"),
        F.nullif(cell("semester"), F.lit("")).alias("semester"), F.nullif(cell("schedule"), F.lit("")).alias("schedule"),
        F.when(missing == 1, "missing_columns").when(code == "", "missing_code")
        .when(status.isNull(), "unknown_status").when(credit.getField("error").isNotNull(), "invalid_credit").alias("error"),
    )


def leading_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?U)^\s*(\d+(?:\.\d+)?)", 1), F.lit(""))


def rule_facts(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_index, text) with their parsed rule parts.

    Adds the header labels, ``total``, ``declared`` struct(category, credits) and ``entry``
    struct(code, name, credits, category) for table-shaped catalogue rows. Line-shaped rows
    depend on categories declared earlier: ``line_entries`` resolves them.
    """
    line_pattern = r"(?U)^[·•\-]?\s*([^\s：:；;]{2,12})[：:]\s*(\d+(?:\.\d+)?)\s*学分"
    body = tx.strip_ws(F.coalesce("text", F.lit("")))

    def parts(text: Column, labels: Column) -> Column:
        def label(name: str) -> Column:
            return F.try_element_at(labels, F.lit(name))

        total_line = F.regexp_extract(text, TOTAL_LABEL + r"[：:]\s*(\d+(?:\.\d+)?)\s*学分", 1)
        category = F.coalesce(*[label(x) for x in CATEGORY_LABELS])
        minimum = leading_number(F.coalesce(*[label(x) for x in MINIMUM_LABELS], F.lit("")))
        fields = [F.nullif(label(x), F.lit("")) for x in ("课程代码", "课程名称", "学分")]
        is_entry = fields[0].isNotNull() & fields[1].isNotNull() & fields[2].isNotNull() & category.isNotNull()
        line_cat = F.regexp_extract(text, line_pattern, 1)
        table_decl = minimum.isNotNull() & (category != "") & (category != TOTAL_LABEL)
        declared = F.when(table_decl, F.struct(category.alias("category"), minimum.alias("credits"))).when(
            (line_cat != "") & (line_cat != TOTAL_LABEL),
            F.struct(line_cat.alias("category"), F.regexp_extract(text, line_pattern, 2).alias("credits")),
        )
        entry = F.struct(
            fields[0].alias("code"), fields[1].alias("name"), fields[2].alias("credits"), category.alias("category")
        )
        return F.struct(
            text.alias("text"),
            *[F.nullif(label(x), F.lit("")).alias(n) for x, n in zip(RULE_LABELS, RULE_FIELDS)],
            F.coalesce(F.nullif(total_line, F.lit("")), leading_number(F.coalesce(label(TOTAL_LABEL), F.lit("")))).alias("total"),
            F.when(is_entry, entry).alias("entry"),
            F.when(~is_entry, declared).alias("declared"),
        )

    parsed = tx.let(body, lambda text: tx.let(labelled_map(text), lambda labels: parts(text, labels)))
    return blocks.select("doc_id", "block_index", parsed.alias("f")).select("doc_id", "block_index", "f.*")


def line_entries(facts: DataFrame) -> DataFrame:
    """Catalogue lines ``CODE name ... credits category ...``: the first number followed by a
    category that an earlier block declared."""
    declared = facts.where("declared IS NOT NULL").groupBy("doc_id", F.col("declared.category").alias("category")).agg(
        F.min("block_index").alias("declared_at")
    )
    tokens = F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")
    lines = facts.where("entry IS NULL").select("doc_id", "block_index", tokens.alias("tok")).where(
        (F.size("tok") >= 4) & F.get("tok", F.lit(0)).rlike(COURSE_CODE)
    )
    spots = lines.select("doc_id", "block_index", "tok", F.posexplode("tok").alias("p", "number")).where(
        (F.col("p") >= 2) & (F.col("p") < F.size("tok") - 1) & F.col("number").rlike(r"^\d+(?:\.\d+)?$")
    ).withColumn("category", F.get("tok", F.col("p") + 1))
    hit = spots.join(declared, ["doc_id", "category"]).where(F.col("declared_at") < F.col("block_index"))
    best = hit.groupBy("doc_id", "block_index").agg(F.min_by(F.struct("tok", "number", "category", "p"), "p").alias("h"))
    return best.select(
        "doc_id", "block_index",
        F.struct(
            F.get("h.tok", F.lit(0)).alias("code"),
            F.array_join(F.slice("h.tok", F.lit(2), F.col("h.p") - 1), " ").alias("name"),
            F.col("h.number").alias("credits"), F.col("h.category").alias("category"),
        ).alias("entry"),
    )


def project_rules(blocks: DataFrame) -> dict[str, DataFrame]:
    """Rule documents -> header, categories, catalog and issues tables.

    Identical repeats are warnings, contradicting repeats and undeclared categories errors.
    """
    facts = rule_facts(blocks)
    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("block_index"))).alias(name)

    header = facts.groupBy("doc_id").agg(*[first(x) for x in RULE_FIELDS], first("total")).select(
        "doc_id", "major", F.regexp_extract("admission_year", r"(\d{4})", 1).try_cast("int").alias("admission_year"),
        "rule_version", "effective_from", F.col("total").try_cast(CREDIT).alias("required_credits"),
    )
    lines = line_entries(facts)
    table_entries = facts.where("entry IS NOT NULL").select("doc_id", "block_index", "entry")
    entries = table_entries.unionByName(lines).select(
        "doc_id", "block_index", F.col("entry.code").alias("course_code"), F.col("entry.name").alias("course_name"),
        F.col("entry.credits").try_cast(CREDIT).alias("credits"), F.col("entry.category").alias("category"),
    )
    declared = facts.where("declared IS NOT NULL").join(lines.select("doc_id", "block_index"), ["doc_id", "block_index"], "left_anti").select(
        "doc_id", "block_index", "declared.category", F.col("declared.credits").try_cast(CREDIT).alias("minimum_credits")
    )
    categories = duplicate_check(declared, ["doc_id", "category"], ["minimum_credits"], "block_index")
    catalog = duplicate_check(entries, ["doc_id", "course_code"], ["course_name", "credits", "category"], "block_index")
    undeclared = catalog.join(categories.select("doc_id", "category"), ["doc_id", "category"], "left_anti")
    issues = (
        categories.where("outcome <> 'unique'").select("doc_id", F.concat(F.lit("category_"), "outcome").alias("issue"), F.col("category").alias("item"))
        .unionByName(catalog.where("outcome <> 'unique'").select("doc_id", F.concat(F.lit("catalog_"), "outcome").alias("issue"), F.col("course_code").alias("item")))
        .unionByName(undeclared.select("doc_id", F.lit("category_undeclared").alias("issue"), F.col("course_code").alias("item")))
    )
    return {"header": header, "categories": categories, "catalog": catalog, "issues": issues}


def duplicate_check(df: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """First row per key with ``outcome``: unique, repeated (identical copies) or conflicting."""
    v = F.struct(*values)
    agg = df.groupBy(*key).agg(
        F.min_by(v, order).alias("v"), F.min(order).alias(order), F.count(F.lit(1)).alias("n"),
        F.min(v).alias("lo"), F.max(v).alias("hi"),
    )
    return agg.select(
        *key, order, "v.*", "n",
        F.when(F.col("n") == 1, "unique").when(F.col("lo").eqNullSafe(F.col("hi")), "repeated").otherwise("conflicting").alias("outcome"),
    )


def required_codes(catalog: DataFrame) -> DataFrame:
    """Courses of categories whose name ends in the compulsory suffix."""
    return catalog.where(F.endswith("category", F.lit(REQUIRED_SUFFIX))).select("doc_id", "category", "course_code")


def set_fingerprints(df: DataFrame, key: str, ordinal: Column, parts: list[Column]) -> DataFrame:
    """Content fingerprint per set: a combinable sum of (ordinal, content) row hashes.

    Ordered like a list digest through the ordinal, yet no set is gathered in one task.
    """
    row = F.concat_ws("\u001f", ordinal.cast("string"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    h = F.conv(F.substring(sha256(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("fingerprint"))


def upsert_actions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """insert / replace / skip per (source_type, source_key, dataset_version) by fingerprint."""
    key = ["source_type", "source_key", "dataset_version"]
    old = existing.select(*key, F.col("fingerprint").alias("old_fp"))
    return incoming.join(old, key, "left").withColumn(
        "action",
        F.when(F.col("old_fp").isNull(), "insert").when(F.col("old_fp") == F.col("fingerprint"), "skip").otherwise("replace"),
    ).drop("old_fp")


def sync_activation(sets: DataFrame, version: Column) -> DataFrame:
    """Demo sets of the active version are active, all other demo sets inactive; uploads stay as they are."""
    wanted = F.when(F.col("dataset_version") == version, F.lit("active")).otherwise(F.lit("inactive"))
    return sets.withColumn("activation_state", F.when(F.col("source_type") == "demo", wanted).otherwise(F.col("activation_state")))


def selectable_sets(sets: DataFrame, documents: DataFrame, pointer: DataFrame) -> DataFrame:
    """Ready sets of live documents: uploads or the active dataset, one row per set."""
    version = pointer.agg(F.min("dataset_version")).scalar()
    visible = (F.col("source_type") == "upload") | ((F.col("source_type") == "demo") & (F.col("dataset_version") == version))
    live = documents.where("NOT deleted").select(F.col("doc_id").alias("source_doc_id"))
    return sets.where((F.col("status") == "ready") & visible).join(live, "source_doc_id", "left_semi").dropDuplicates(["set_id"])


# --- resolution (A11, A12, A16) -------------------------------------------------

def resolve_status(records: DataFrame) -> DataFrame:
    """One row per (set, course): passed beats in progress, the first record of that status counts.

    The records are dealt out by set: a course seldom repeats in a set, so sums made before are wider than the records,
    and what is joined by set needs no further shuffle.
    """
    def first(status: str) -> Column:
        return F.min_by(
            F.struct("category", "credits"), F.when(F.col("status") == status, F.col("ordinal"))
        )

    agg = records.repartition("set_id").groupBy("set_id", "course_code").agg(
        F.max(F.col("status") == "passed").alias("passed"),
        F.max(F.col("status") == "in_progress").alias("ongoing"),
        F.max(F.col("status") == "failed").alias("failed"),
        first("passed").alias("p"), first("in_progress").alias("o"),
    )
    source = F.when(F.col("passed"), F.col("p")).otherwise(F.col("o"))
    return agg.select(
        "set_id", "course_code",
        F.when(F.col("passed"), "passed").when(F.col("ongoing"), "in_progress").otherwise("failed").alias("state"),
        source["category"].alias("record_category"), source["credits"].alias("record_credits"),
        ((F.col("failed") & (F.col("passed") | F.col("ongoing"))) | (F.col("passed") & F.col("ongoing"))).alias("contradictory"),
    )


def resolve_credit(resolved: DataFrame, pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue credits and category override the record's own, per pair."""
    counted = resolved.where("state <> 'failed'").join(shuffled(pairs), "set_id")
    c = catalog.select(
        "rule_set_id", "course_code", F.col("category").alias("rule_category"), F.col("credits").alias("rule_credits")
    )
    j = counted.join(shuffled(c), ["rule_set_id", "course_code"], "left")
    listed = F.col("rule_credits").isNotNull()
    return j.select(
        *KEY, "course_code", "state", "contradictory",
        F.coalesce("rule_category", "record_category", F.lit("")).alias("category"),
        F.coalesce("rule_credits", "record_credits").cast(CREDIT).alias("credits"),
        (~listed).alias("unlisted"),
        (listed & (F.coalesce("record_category", F.lit("")) != "") & (F.col("record_category") != F.col("rule_category"))).alias("mismatch"),
    )


# --- results (A13-A15) ------------------------------------------------------------

def _sum_state(state: str) -> Column:
    zero = F.lit(0).cast(CREDIT)
    return quantise(F.coalesce(F.sum(F.when(F.col("state") == state, F.col("credits")).otherwise(zero)), F.lit(0)))


def _remaining(required: Column) -> Column:
    """Required minus the quantised sums, not below zero; the required value itself stays exact."""
    return F.greatest(required - F.col("completed") - F.col("in_progress"), F.lit(0).cast("decimal(12,4)"))


def totals(pairs: DataFrame, credited: DataFrame, rule_sets: DataFrame) -> DataFrame:
    agg = credited.groupBy(*KEY).agg(_sum_state("passed").alias("completed"), _sum_state("in_progress").alias("in_progress"))
    zero = F.lit(0).cast("decimal(12,1)")
    return (
        pairs.join(F.broadcast(rule_sets.select("rule_set_id", F.col("required_credits").alias("required"))), "rule_set_id")
        .join(shuffled(agg), KEY, "left")
        .withColumn("completed", F.coalesce("completed", zero))
        .withColumn("in_progress", F.coalesce("in_progress", zero))
        .select(*KEY, "required", "completed", "in_progress", _remaining(F.col("required")).cast("decimal(12,1)").alias("remaining"))
    )


def category_gaps(pairs: DataFrame, credited: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per declared category, also where nothing was taken."""
    agg = credited.groupBy(*KEY, "category").agg(_sum_state("passed").alias("completed"), _sum_state("in_progress").alias("in_progress"))
    zero = F.lit(0).cast("decimal(12,1)")
    return (
        pairs.join(F.broadcast(categories), "rule_set_id").join(shuffled(agg), [*KEY, "category"], "left")
        .withColumn("completed", F.coalesce("completed", zero))
        .withColumn("in_progress", F.coalesce("in_progress", zero))
        .select(
            *KEY, "ordinal", "category", F.col("minimum_credits").alias("required"), "completed", "in_progress",
            _remaining(F.col("minimum_credits")).cast("decimal(12,1)").alias("remaining"),
        )
    )


def missing_required(pairs: DataFrame, resolved: DataFrame, required: DataFrame, catalog: DataFrame) -> DataFrame:
    """Required courses neither passed nor in progress; a code required twice is listed twice.

    The rule definition is looked up in the catalogue once, and a set brings only those of its courses that any rule set
    requires: what every pair would have to take is neither shuffled nor looked up again.
    """
    codes = required.select("course_code").distinct()
    counted = resolved.where("state <> 'failed'").join(F.broadcast(codes), "course_code", "left_semi")
    taken = counted.groupBy("set_id").agg(F.collect_set("course_code").alias("taken"))
    open_ = pairs.join(shuffled(taken), "set_id", "left").join(F.broadcast(named_required(required, catalog)), "rule_set_id")
    return open_.where(~F.coalesce(F.array_contains("taken", F.col("course_code")), F.lit(False))).drop("taken").select(
        *KEY, "ordinal", "position", "course_code", "course_name", "credits", "category", "unknown"
    )


def named_required(required: DataFrame, catalog: DataFrame) -> DataFrame:
    """The required courses with name, credits and category of the catalogue; ``unknown`` where it doesn't list them."""
    wanted = required.select("rule_set_id", "course_code").distinct()
    c = catalog.join(F.broadcast(wanted), ["rule_set_id", "course_code"], "left_semi").select(
        "rule_set_id", "course_code", "course_name", F.col("credits").alias("c_credits"), F.col("category").alias("c_category")
    )
    return required.join(F.broadcast(c), ["rule_set_id", "course_code"], "left").select(
        "rule_set_id", "ordinal", "position", "course_code",
        F.coalesce("course_name", "course_code").alias("course_name"),
        F.coalesce("c_credits", F.lit(0)).cast(CREDIT).alias("credits"),
        F.coalesce("c_category", "category").alias("category"),
        F.col("c_credits").isNull().alias("unknown"),
    )


def other_versions(rule_sets: DataFrame) -> DataFrame:
    """Other versions of the same major per rule set, as a sorted list.

    The versions of a major are gathered once; no rule set is paired with another.
    """
    per_major = rule_sets.groupBy("major").agg(F.collect_set("rule_version").alias("versions"))
    return rule_sets.join(per_major, "major").select(
        "rule_set_id", "major", "rule_version",
        F.array_sort(F.array_remove("versions", F.col("rule_version"))).alias("others"),
    )


# --- warnings (A24, A25) -----------------------------------------------------------

def warning_items(
    pairs: DataFrame, credited: DataFrame, missing: DataFrame, rule_sets: DataFrame, time_items: DataFrame | None = None
) -> DataFrame:
    """(set_id, rule_set_id, ordinal, code, item): every item behind every warning, as rows."""
    def rows(df: DataFrame, code: str, item: Column) -> DataFrame:
        return df.select(*KEY, F.lit(WARNINGS.index(code)).alias("ordinal"), F.lit(code).alias("code"), item.cast("string").alias("item"))

    versions = pairs.join(F.broadcast(other_versions(rule_sets)), "rule_set_id").select(*KEY, F.explode("others").alias("v"))
    out = rows(versions, WARNINGS[0], F.col("v"))
    if time_items is not None:
        out = out.unionByName(rows(time_items.join(shuffled(pairs), "set_id"), WARNINGS[1], F.col("item")))
    # the three course flags leave the credited rows in one pass
    flags = F.filter(
        F.array(
            *[
                F.when(F.col(flag), F.lit(WARNINGS[i]))
                for flag, i in (("mismatch", 2), ("contradictory", 3), ("unlisted", 4))
            ]
        ),
        lambda x: x.isNotNull(),
    )
    flagged = credited.where("mismatch OR contradictory OR unlisted").select(*KEY, F.explode(flags).alias("code"), "course_code")
    order = F.create_map(*[F.lit(x) for i, w in enumerate(WARNINGS) for x in (w, i)])
    out = out.unionByName(
        flagged.select(*KEY, F.element_at(order, F.col("code")).alias("ordinal"), "code", F.col("course_code").alias("item"))
    )
    return out.unionByName(rows(missing.where("unknown").distinct(), WARNINGS[5], F.col("course_code"))).distinct()


def time_items(conflicts: DataFrame) -> DataFrame:
    """Course pairs of ``schedule_conflicts`` as (set_id, item) of the time warning."""
    return conflicts.select("set_id", F.concat_ws("|", "left_code", "right_code").alias("item"))


def warnings(items: DataFrame) -> DataFrame:
    """One row per warning with its number of items and the first and last of them, at any size.

    The items themselves stay rows of ``items``: no warning is gathered whole.
    """
    return items.groupBy(*KEY, "ordinal", "code").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("item").alias("first_item"), F.max("item").alias("last_item")
    )


def warning_evidence(warning_rows: DataFrame, record_chunks: DataFrame, rule_chunks: DataFrame) -> DataFrame:
    """Evidence chunk ids per warning.

    record_chunks (set_id, chunk_id), rule_chunks (rule_set_id, kind header|category|course,
    item, chunk_id). Record-based warnings cite the record rows, unknown required courses the
    category rows (else the header), a version conflict the header. The warnings are stored once for both kinds; links of
    distinct warnings to distinct chunks are distinct, so the links themselves, the many, are not shuffled for that.
    """
    kinds = stored(warning_rows.select(*KEY, "code").distinct(), "warnings")
    on_records = kinds.where(F.col("code").isin(WARNINGS[2], WARNINGS[3], WARNINGS[4]))
    on_rules = kinds.where(F.col("code").isin(WARNINGS[0], WARNINGS[5]))
    has_category = rule_chunks.where("kind = 'category'").select("rule_set_id").distinct().withColumn("has_category", F.lit(True))
    r = on_rules.join(F.broadcast(has_category), "rule_set_id", "left").withColumn(
        "kind", F.when((F.col("code") == WARNINGS[5]) & F.coalesce("has_category", F.lit(False)), "category").otherwise("header")
    )
    a = on_records.join(shuffled(record_chunks.select("set_id", "chunk_id").distinct()), "set_id").select(*KEY, "code", "chunk_id")
    cited = rule_chunks.where("kind <> 'course'").select("rule_set_id", "kind", "chunk_id").distinct()
    b = r.join(F.broadcast(cited), ["rule_set_id", "kind"]).select(*KEY, "code", "chunk_id")
    return a.unionByName(b)


def missing_evidence(missing: DataFrame, rule_chunks: DataFrame) -> DataFrame:
    """Chunk behind a missing course: its catalogue row, else its category row, else the header."""
    def side(kind: str) -> DataFrame:
        return rule_chunks.where(F.col("kind") == kind).groupBy("rule_set_id", "item").agg(F.min("chunk_id").alias(kind))

    head = side("header").select("rule_set_id", F.col("header").alias("header_chunk"))
    course = side("course").select("rule_set_id", F.col("item").alias("course_code"), F.col("course").alias("course_chunk"))
    category = side("category").select("rule_set_id", F.col("item").alias("category"), F.col("category").alias("category_chunk"))
    return (
        missing.join(shuffled(course), ["rule_set_id", "course_code"], "left")
        .join(F.broadcast(category), ["rule_set_id", "category"], "left")
        .join(F.broadcast(head), "rule_set_id", "left")
        .select(*KEY, "course_code", F.coalesce("course_chunk", "category_chunk", "header_chunk").alias("chunk_id"))
    )


def load_evidence(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id) -> the same with the first reason why it cannot be shown (null = fine).

    chunks: (chunk_id, owner, file_type, locator struct).
    """
    one = wanted.select("chunk_id", "doc_id").dropDuplicates(["chunk_id", "doc_id"])
    j = one.join(chunks, "chunk_id", "left")
    loc = F.col("locator")
    rows_ok = (
        (F.trim(F.coalesce(loc["sheet_name"], F.lit(""))) != "") & (loc["row_start"] > 0) & (loc["row_end"] > 0)
        & (loc["row_start"] <= loc["row_end"])
    )
    page_ok = F.coalesce(loc["page_number"] > 0, F.lit(False)) | (F.trim(F.coalesce(loc["section_title"], F.lit(""))) != "")
    shown = F.when(F.col("file_type") == "xlsx", F.coalesce(rows_ok, F.lit(False))).otherwise(page_ok)
    return j.select(
        "chunk_id", "doc_id",
        F.when(F.col("owner").isNull(), "chunk_missing").when(F.col("owner") != F.col("doc_id"), "doc_mismatch")
        .when(~shown, "locator_incomplete").alias("reason"),
    )


# --- assembly (A26-A28) --------------------------------------------------------------

def plan_rows(total: DataFrame, gaps: DataFrame, missing: DataFrame, warning_rows: DataFrame) -> DataFrame:
    """One row per pair: totals, gap and missing structs in declared order, warning codes.

    The lists are bounded by the rule definition (declared categories, required courses, six
    warning kinds), not by the records.
    """
    g = gaps.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "category", "required", "completed", "in_progress", "remaining"))).alias("gaps")
    )
    m = missing.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "position", "course_code", "course_name", "credits", "category"))).alias("missing")
    )
    w = warning_rows.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "code"))), lambda x: x["code"]).alias("warning_codes")
    )
    return total.join(shuffled(g), KEY, "left").join(shuffled(m), KEY, "left").join(shuffled(w), KEY, "left")


def plans_by_set(
    pairs: DataFrame, credited: DataFrame, rule_sets: DataFrame, categories: DataFrame, required: DataFrame, catalog: DataFrame
) -> DataFrame:
    """The rows of ``plan_rows`` for distinct pairs without time warnings, from one pass over the credited courses.

    These are dealt out by set once and summed where they lie. Categories, required courses and other versions are lists
    of a rule set, the rule definition, so gaps and missing courses are made inside the pair's own row.
    """
    def state(name: str) -> Column:
        return F.sum(F.when(F.col("state") == name, F.col("credits")).otherwise(F.lit(0).cast(CREDIT)))

    def kept(values: Column) -> Column:
        return F.when(F.size(values) > 0, values)

    flags = ("mismatch", "contradictory", "unlisted")
    codes = required.select("course_code", F.lit(True).alias("is_required")).distinct()
    own = credited.join(F.broadcast(codes), "course_code", "left").select(
        *KEY, "category", "state", "credits", *flags, F.when(F.col("is_required"), F.col("course_code")).alias("taken")
    )
    per_category = own.repartition("set_id").groupBy(*KEY, "category").agg(
        state("passed").alias("completed"), state("in_progress").alias("in_progress"), *[F.max(c).alias(c) for c in flags], F.collect_set("taken").alias("taken")
    )
    sums = F.struct("category", F.struct("completed", "in_progress"))
    per_pair = per_category.groupBy(*KEY).agg(
        F.sum("completed").alias("p"), F.sum("in_progress").alias("o"), *[F.max(c).alias(c) for c in flags],
        F.flatten(F.collect_list("taken")).alias("taken"), F.map_from_entries(F.collect_list(sums)).alias("sums"),
    )
    declared = categories.groupBy("rule_set_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "category", "minimum_credits"))).alias("declared"))
    course = F.struct("ordinal", "position", "course_code", "course_name", "credits", "category", "unknown")
    wanted = named_required(required, catalog).groupBy("rule_set_id").agg(F.array_sort(F.collect_list(course)).alias("wanted"))
    rules = rule_sets.select("rule_set_id", F.col("required_credits").alias("required"))
    for definition in (declared, wanted, other_versions(rule_sets).select("rule_set_id", "others")):
        rules = rules.join(F.broadcast(definition), "rule_set_id", "left")
    j = pairs.repartition("set_id").join(F.broadcast(rules), "rule_set_id").join(shuffled(per_pair), KEY, "left")

    def gap(c: Column) -> Column:
        found = F.try_element_at("sums", c["category"])
        done, ongoing = (quantise(F.coalesce(found[name], F.lit(0))) for name in ("completed", "in_progress"))
        left = F.greatest(c["minimum_credits"] - done - ongoing, F.lit(0).cast("decimal(12,4)")).cast("decimal(12,1)")
        return F.struct(
            c["ordinal"].alias("ordinal"), c["category"].alias("category"), c["minimum_credits"].alias("required"),
            done.alias("completed"), ongoing.alias("in_progress"), left.alias("remaining"),
        )

    done = F.coalesce("taken", F.array().cast("array<string>"))
    open_ = F.filter("wanted", lambda c: ~F.coalesce(F.array_contains(done, c["course_code"]), F.lit(False)))
    j = j.select(
        *KEY, "required", quantise(F.coalesce("p", F.lit(0))).alias("completed"), quantise(F.coalesce("o", F.lit(0))).alias("in_progress"),
        F.transform("declared", gap).cast(GAPS).alias("gaps"), F.explode(F.array(open_)).alias("open"), "others", *flags,
    )
    warned = [F.size("others") > 0, F.col("mismatch"), F.col("contradictory"), F.col("unlisted"), F.exists("open", lambda c: c["unknown"])]
    named = F.array_compact(F.array(*[F.when(w, F.lit(WARNINGS[i])) for w, i in zip(warned, (0, 2, 3, 4, 5))]))
    return j.select(
        *KEY, "required", "completed", "in_progress", _remaining(F.col("required")).cast("decimal(12,1)").alias("remaining"), kept(F.col("gaps")).alias("gaps"),
        kept(F.transform("open", lambda c: F.struct(*[c[n].alias(n) for n in ("ordinal", "position", "course_code", "course_name", "credits", "category")]))).alias("missing"),
        kept(named).alias("warning_codes"),
    )


def plan_invariants(total: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per pair: which of the arithmetic invariants hold."""
    g = gaps.groupBy(*KEY).agg(
        F.sum("completed").alias("g_completed"), F.sum("in_progress").alias("g_ongoing"),
        F.min(F.col("remaining") == _remaining(F.col("required")).cast("decimal(12,1)")).alias("gaps_ok"),
    )
    j = total.join(shuffled(g), KEY, "left")
    return j.select(
        *KEY,
        ((F.col("completed") >= 0) & (F.col("in_progress") >= 0) & (F.col("required") >= 0)).alias("non_negative"),
        (F.col("remaining") == _remaining(F.col("required")).cast("decimal(12,1)")).alias("remaining_ok"),
        (F.coalesce("g_completed", F.lit(0)) == F.col("completed")).alias("completed_ok"),
        (F.coalesce("g_ongoing", F.lit(0)) == F.col("in_progress")).alias("in_progress_ok"),
        F.coalesce("gaps_ok", F.lit(True)).alias("gaps_ok"),
    )


def plan_diff(produced: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Mismatch flags of two plan tables; warning codes must start with the expected ones."""
    p = produced.select(*key, F.struct(*[c for c in produced.columns if c not in key]).alias("p"))
    e = expected.select(*key, F.struct(*[c for c in expected.columns if c not in key]).alias("e"))
    j = p.join(shuffled(e), key)
    codes = F.coalesce("p.warning_codes", F.array().cast("array<string>"))
    want = F.coalesce("e.warning_codes", F.array().cast("array<string>"))
    return j.select(
        *key,
        *[
            (~F.col(f"p.{c}").eqNullSafe(F.col(f"e.{c}"))).alias(f"{c}_differs")
            for c in ("required", "completed", "in_progress", "remaining", "missing", "gaps")
        ],
        (~F.slice(codes, F.lit(1), F.size(want)).eqNullSafe(want)).alias("warnings_differ"),
    )


# --- time (A18-A22) --------------------------------------------------------------------

def schedule_slots(records: DataFrame) -> DataFrame:
    """In-progress records with a readable term and slot as (set_id, term, course_code, weekday, unit, start, end)."""
    # a generator reads each text once; a filter on the slot would have it parsed again for the filter and each field
    read = records.where("status = 'in_progress'").select(
        "set_id", tx.norm_term(F.col("semester")).alias("term"), "course_code", F.inline(F.array_compact(F.array(tx.parse_slot(F.col("schedule")))))
    )
    return read.where("term IS NOT NULL")


def merged_slots(slots: DataFrame) -> DataFrame:
    """The slots of a course at one place as disjoint half-open ranges: overlapping ones become one.

    Slots with the same start collapse to the longest one first, so a course has at most one row per
    minute. Ranges that only touch stay apart, because an empty slot between them meets neither.
    """
    place = ["set_id", "term", "weekday", "unit", "course_code"]
    until = F.when(F.col("unit") == "clock", F.col("end")).otherwise(F.col("end") + 1)
    longest = slots.groupBy(*place, "start").agg(F.max(until).alias("end"))
    course = Window.partitionBy(*place).orderBy("start")
    reached = F.max("end").over(course.rowsBetween(Window.unboundedPreceding, -1))
    opens = longest.withColumn("opens", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    island = opens.withColumn("island", F.sum("opens").over(course.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*place, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def schedule_conflicts(slots: DataFrame, levels: int = 13) -> DataFrame:
    """Distinct course pairs of one set that overlap in the same term, weekday and unit.

    Clock ranges are half open, period ranges closed. Of two ranges that overlap, one holds the
    start of the other. A range is cut into blocks of lengths 1, 2, 4 to 2**levels that tile it
    exactly, a start stands in one block of each length, and both meet by block: the join gives the
    true overlaps of the merged ranges and no other pairs, however crowded an hour is. ``levels``
    must let 2**levels cover the largest end.
    """
    place = ["set_id", "term", "weekday", "unit"]
    ranges = merged_slots(slots)
    steps = F.sequence(F.lit(0), F.lit(levels))

    def block(level: Column, cell: Column) -> Column:
        return F.struct(level.alias("level"), cell.cast("long").alias("cell"))

    def tiles(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        low, high = F.ceil(F.col("start") / size), F.floor(F.col("end") / size)
        odd = (low < high) & (F.pmod(low, F.lit(2)) == 1), (low < high) & (F.pmod(high, F.lit(2)) == 1)
        return F.array_compact(F.array(F.when(odd[0], block(level, low)), F.when(odd[1], block(level, high - 1))))

    holding = ranges.withColumn("b", F.explode(F.flatten(F.transform(steps, tiles))))
    starting = ranges.withColumn("b", F.explode(F.transform(steps, lambda k: block(k, F.floor(F.col("start") / F.pow(F.lit(2.0), k))))))
    left = holding.select(*place, "b.level", "b.cell", F.col("course_code").alias("c1"), F.col("start").alias("s1"))
    right = starting.select(*place, "b.level", "b.cell", F.col("course_code").alias("c2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    # an empty slot that stands at the start of a range doesn't overlap it
    met = left.join(right, [*place, "level", "cell"]).where("c1 <> c2 AND s1 < e2")
    return met.select("set_id", F.least("c1", "c2").alias("left_code"), F.greatest("c1", "c2").alias("right_code")).distinct()


def timetable_conflicts(timetable: DataFrame, in_progress: DataFrame) -> DataFrame:
    """Slots of a shared timetable that hold two or more courses, for every set taking one of them.

    timetable (doc_id, term, weekday, period, course_code), in_progress (set_id, term, course_code).
    """
    slot = ["doc_id", "term", "weekday", "period"]
    codes = timetable.select(*slot, "course_code").distinct()
    crowded = codes.groupBy(*slot).agg(F.count(F.lit(1)).alias("n_codes")).where("n_codes >= 2")
    taken = in_progress.select("set_id", "term", "course_code").distinct()
    # crowded slots first: only their courses meet the sets that take them
    return codes.join(crowded, slot).join(taken, ["term", "course_code"]).select("set_id", *slot, "n_codes").distinct()


def narrowest_cover(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk that covers each target range most closely.

    targets (target_id, doc_id, start, end), chunks (chunk_id, doc_id, chunk_index, start, end).
    Chunks fall into a grid whose width is the power of two above their span, so each sits in
    at most two cells; a target looks up one cell per width in use. Hot documents are thereby
    spread over their row ranges. Exact match first, then span, chunk index, chunk id.
    """
    span = F.col("end") - F.col("start")
    c = chunks.where(span >= 0).withColumn("level", F.ceil(F.log2((span + 1).cast("double"))).cast("int"))
    width = F.pow(F.lit(2.0), F.col("level"))
    c = c.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))))
    top = c.agg(F.coalesce(F.max("level"), F.lit(0))).scalar()
    t = targets.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    t = t.withColumn("cell", F.floor(F.col("start") / F.pow(F.lit(2.0), F.col("level"))))
    c = c.select("doc_id", "level", "cell", "chunk_id", "chunk_index", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    hit = t.join(c, ["doc_id", "level", "cell"]).where((F.col("c_start") <= F.col("start")) & (F.col("c_end") >= F.col("end")))
    inexact = ~((F.col("c_start") == F.col("start")) & (F.col("c_end") == F.col("end")))
    best = F.min(F.struct(inexact.alias("inexact"), (F.col("c_end") - F.col("c_start")).alias("span"), "chunk_index", "chunk_id"))
    found = hit.groupBy("target_id").agg(best.alias("b"))
    return targets.select("target_id").join(found, "target_id", "left").select(
        "target_id", F.col("b.chunk_id").alias("chunk_id"), F.col("b.span").alias("span"), (~F.col("b.inexact")).alias("exact")
    )


def page_cover(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk of the same page; an equal section wins, then chunk index and id.

    targets (target_id, doc_id, page_number, section_title), chunks likewise with chunk_id, chunk_index.
    """
    c = chunks.groupBy("doc_id", "page_number", "section_title").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("c"))
    by_section = c.select("doc_id", "page_number", "section_title", F.col("c").alias("exact"))
    by_page = c.groupBy("doc_id", "page_number").agg(F.min("c").alias("any"))
    return (
        targets.join(by_section, ["doc_id", "page_number", "section_title"], "left")
        .join(by_page, ["doc_id", "page_number"], "left")
        .select("target_id", F.coalesce("exact", "any")["chunk_id"].alias("chunk_id"))
    )
