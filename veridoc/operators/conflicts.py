"""Contradictions inside evidence: versions that disagree, slots filled twice.

Evidence rows are (group_id, idx, text, version, doc_id); a group is one question or
one case. Every test is a set of combinable aggregates joined back on its key, so a hot
key or slot is never sorted or listed in one task and no pairs are built to find out who
takes part in a conflict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import text as tx
from veridoc.functions.digest import sha256

# --- fixed values -----------------------------------------------------------
METADATA_KEYS = (
    "文档版本", "生效日期", "文档类型", "更新时间", "适用学期", "适用专业", "适用年级", "专业代码",
    "招生年份", "学制", "所属学院", "授予学位",
)
PAIR = r"(?U)([^\s：:，。；;、|｜]{2,12})[：:]\s*([^\n]{1,30})"
VALUE_TERMINATORS = "。；;，,　|｜"
CELL_SPLIT = r"(?U)\s*[|｜]\s*|\t+|\s{2,}"
VERSION_MARK = r"(?<![0-9.])([0-9]{4}[.][0-9]{1,2})(?![0-9.])"
WEEKDAY = "(星期|周|礼拜)[一二三四五六日天]"
PERIOD = r"第?\d+(?:-\d+)?节"
CROSS_MARKERS = (
    "不同版本", "各版本", "两个版本", "两版", "版本差异", "版本之间", "版本对比", "版本比较", "跨版本",
    "不同文件", "各文件", "两个文件", "跨文件", "文件差异", "文件对比", "文件比较",
    "不同文档", "各文档", "两个文档", "跨文档", "文档差异", "文档对比", "文档比较",
    "不同资料", "各资料", "两个资料", "跨资料", "资料差异", "资料对比", "资料比较",
    "不同来源", "各来源", "两个来源", "跨来源", "来源差异", "来源对比", "来源比较",
)
COMPARE_MARKERS = (
    "是否一致", "一致吗", "不一致", "有无冲突", "是否冲突", "冲突吗", "差异", "区别", "对比", "比较", "冲突",
)
SCOPE_WORDS = ("版本", "文件", "文档", "资料", "来源")
SLOT_MARKERS = (
    "同一时间段安排", "同一时段安排", "同时安排", "重复排课", "排课冲突", "课表冲突", "课程安排冲突",
)
SLOT_CONTEXT = ("课表", "排课")
SLOT_QUERY = (
    "哪些课程", "哪几门课", "哪些课", "什么课程", "什么课", "哪门课", "有哪些课", "上什么课", "哪些科目", "安排了哪些",
)
PLANNING_MARKERS = (
    "还差", "差多少", "缺多少", "缺几门", "如何规划", "怎么规划", "规划建议", "规划方案", "能否毕业", "能不能毕业", "我的学分",
)
SUPPRESSED_CROSS = "cross_version_not_requested"
SUPPRESSED_SLOT = "row_slot_not_requested"
SUPPRESSED_BOTH = "conflict_intent_not_requested"
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Markers:
    """Marker lists of the intent tests; other languages pass their own."""

    cross: tuple[str, ...] = CROSS_MARKERS
    compare: tuple[str, ...] = COMPARE_MARKERS
    scope: tuple[str, ...] = SCOPE_WORDS
    slot: tuple[str, ...] = SLOT_MARKERS
    slot_context: tuple[str, ...] = SLOT_CONTEXT
    slot_query: tuple[str, ...] = SLOT_QUERY
    weekday: str = WEEKDAY
    period: str = PERIOD


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def squash(c: Column) -> Column:
    """No white space, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


# --- field pairs (G5) -----------------------------------------------------------

def norm_value(c: Column, truncate: bool = False) -> Column:
    """Value form of a pair. By default only white space goes; ``truncate`` also cuts at the
    first terminator character."""
    cut = F.regexp_extract(c, "^([^" + VALUE_TERMINATORS + "]*)", 1) if truncate else c
    return squash(cut)


def pair_list(text: Column, truncate: bool = False) -> Column:
    """array<struct<key,value>> in text order, metadata keys left out."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PAIR), F.lit(0))
    pairs = F.transform(
        hits,
        lambda h: F.struct(
            F.regexp_extract(h, PAIR, 1).alias("key"), norm_value(F.regexp_extract(h, PAIR, 2), truncate).alias("value")
        ),
    )
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "") & ~p["key"].isin(*METADATA_KEYS))


def observed_pairs(evidence: DataFrame, truncate: bool = False) -> DataFrame:
    """(group_id, key, version, value, idx, pos)."""
    return evidence.select(
        "group_id", "idx", F.coalesce("version", F.lit("")).alias("version"),
        F.posexplode(pair_list(F.col("text"), truncate)).alias("pos", "p"),
    ).select("group_id", F.col("p.key").alias("key"), "version", F.col("p.value").alias("value"), "idx", "pos")


# --- cross-version (G6) -----------------------------------------------------------

def first_values(observed: DataFrame) -> DataFrame:
    """Only the first value of each (group, key, version) counts."""
    return observed.groupBy("group_id", "key", "version").agg(
        F.min_by(F.struct("value", "idx"), F.struct("idx", "pos")).alias("f")
    ).select("group_id", "key", "version", "f.value", "f.idx")


def cross_version_participants(observed: DataFrame) -> DataFrame:
    """Versions whose value is contradicted by another version from other evidence.

    A row has such a counterpart exactly when rows remain after removing those with its
    value and those with its index; four counts per key decide that without any pairing.
    """
    f = first_values(observed)
    key = ["group_id", "key"]

    def counts(extra: list[str], name: str) -> DataFrame:
        return f.groupBy(*key, *extra).agg(F.count(F.lit(1)).alias(name))

    j = (
        f.join(counts([], "n"), key).where("n > 1")
        .join(counts(["value"], "n_value"), [*key, "value"])
        .join(counts(["idx"], "n_idx"), [*key, "idx"])
        .join(counts(["value", "idx"], "n_both"), [*key, "value", "idx"])
    )
    return j.where(F.col("n") - F.col("n_value") - F.col("n_idx") + F.col("n_both") > 0).select(
        *key, "version", "value", "idx"
    )


def cross_version_fields(observed: DataFrame) -> DataFrame:
    """(group_id, key, n_versions, lo, hi): the contradicted versions of each field and their first and last index.

    Linear in the observations however many versions disagree; the versions themselves are the
    rows of ``cross_version_participants``.
    """
    return cross_version_participants(observed).groupBy("group_id", "key").agg(
        F.count(F.lit(1)).alias("n_versions"), F.min("idx").alias("lo"), F.max("idx").alias("hi")
    )


# --- row slots (G7, G8) -------------------------------------------------------------

def row_list(text: Column) -> Column:
    """array<struct<a,b,body>> of the comparable lines of a text."""
    def cells_of(line: Column) -> Column:
        return F.filter(F.transform(F.split(line, CELL_SPLIT), tx.strip_ws), lambda c: c != "")

    def kv(line: Column) -> Column:
        segs = F.filter(F.transform(F.split(line, "[；;]"), tx.strip_ws), lambda s: s != "")

        def one(seg: Column) -> Column:
            at = F.coalesce(F.nullif(F.instr(seg, "："), F.lit(0)), F.nullif(F.instr(seg, ":"), F.lit(0)))
            return tx.let(
                at,
                lambda i: F.struct(
                    tx.strip_ws(F.substring(seg, F.lit(1), i - 1)).alias("k"),
                    norm_value(F.substring(seg, i + 1, F.length(seg))).alias("v"),
                ),
            )

        def build(ps: Column) -> Column:
            bad = F.exists(ps, lambda p: p["k"].isNull() | (p["k"] == "") | F.coalesce(p["v"] == "", F.lit(True)))
            text_of = lambda p: F.concat(p["k"], F.lit("="), p["v"])
            return F.when(
                (F.size(ps) >= 3) & ~bad,
                F.struct(
                    text_of(ps[0]).alias("a"), text_of(F.get(ps, F.lit(1))).alias("b"),
                    F.array_join(F.transform(F.slice(ps, F.lit(3), F.greatest(F.size(ps) - 2, F.lit(0))), text_of), ";").alias("body"),
                ),
            )

        return tx.let(F.transform(segs, one), build)

    def line_row(line: Column) -> Column:
        return tx.let(
            cells_of(line),
            lambda cs: F.when(
                F.size(cs) >= 3,
                F.struct(
                    cs[0].alias("a"), F.get(cs, F.lit(1)).alias("b"),
                    F.array_join(F.slice(cs, F.lit(3), F.greatest(F.size(cs) - 2, F.lit(0))), "|").alias("body"),
                ),
            ).otherwise(kv(line)),
        )

    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\r\n]"), tx.strip_ws), lambda x: x != "")
    return F.filter(F.transform(lines, line_row), lambda r: r.isNotNull())


def row_records(evidence: DataFrame) -> DataFrame:
    """(group_id, doc_id, a, b, body, idx, pos) with pos = (idx, line)."""
    return evidence.select(
        "group_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "idx",
        F.posexplode(row_list(F.col("text"))).alias("line", "r"),
    ).select("group_id", "doc_id", "r.a", "r.b", "r.body", "idx", F.struct("idx", "line").alias("pos"))


def slot_hits(rows: DataFrame) -> DataFrame:
    """(group_id, doc_id, a, b, idx) of rows taking part in a slot conflict.

    Per slot only the first body, its first position and the first position of any other
    body are needed. A row is hit when its body differs from the first one, when it comes
    after the first other body, or when it is the very first row of a contested slot.
    """
    slot = ["group_id", "doc_id", "a", "b"]
    bodies = rows.groupBy(*slot, "body").agg(F.min("pos").alias("first_pos"))
    firsts = bodies.groupBy(*slot).agg(
        F.min("first_pos").alias("p0"), F.min_by("body", "first_pos").alias("b0"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    others = (
        bodies.join(firsts, slot).where(F.col("body") != F.col("b0"))
        .groupBy(*slot).agg(F.min("first_pos").alias("p1"))
    )
    contested = firsts.select(*slot, "p0", "b0").join(others, slot)
    hit = (F.col("body") != F.col("b0")) | (F.col("pos") > F.col("p1")) | (F.col("pos") == F.col("p0"))
    return rows.join(contested, slot).where(hit).select(*slot, "idx").distinct()


# --- summary and activation (G9-G11) ---------------------------------------------------

def conflict_keys(participants: DataFrame, hits: DataFrame) -> DataFrame:
    """Distinct conflicting field and slot keys per group: (group_id, signal, key)."""
    a = participants.select("group_id", F.lit("cross_version").alias("signal"), "key")
    b = hits.select("group_id", F.lit("row_slot").alias("signal"), F.concat_ws("|", "a", "b").alias("key"))
    return a.unionByName(b).distinct()


def conflict_summary(participants: DataFrame, hits: DataFrame) -> DataFrame:
    """Per group: signals, number of evidence rows and keys, and a digest of the key set.

    The digest adds one hash per distinct normalised key, so equal key sets have equal
    digests whatever their order and no key list is gathered.
    """
    keys = conflict_keys(participants, hits)
    norm = keys.select("group_id", "signal", squash(F.col("key")).alias("k")).distinct()
    h = F.conv(F.substring(sha256(F.concat_ws("\u001f", "signal", "k")), 1, 15), 16, 10).cast("decimal(38,0)")
    digest = norm.where("k <> ''").groupBy("group_id").agg(F.sum(h).cast("string").alias("field_digest"))
    idx = participants.select("group_id", "idx").unionByName(hits.select("group_id", "idx")).distinct()
    n_idx = idx.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_indices"), F.min("idx").alias("first_index"))
    n_keys = keys.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("field_count"),
        F.max(F.col("signal") == "cross_version").alias("has_cross"),
        F.max(F.col("signal") == "row_slot").alias("has_slot"),
    )
    return n_keys.join(n_idx, "group_id").join(digest, "group_id", "left")


def conflict_members(participants: DataFrame, hits: DataFrame) -> DataFrame:
    """What a summary counts, as rows in order: every index of a group once, and every distinct field key with its signal.

    Rows (group_id, member, idx, signal, key) are sorted in ranges; a group with many members lies in several of them.
    """
    idx = participants.select("group_id", "idx").unionByName(hits.select("group_id", "idx")).distinct()
    indices = idx.select("group_id", F.lit("index").alias("member"), "idx", F.lit(None).cast("string").alias("signal"), F.lit(None).cast("string").alias("key"))
    fields = conflict_keys(participants, hits).withColumn("member", F.lit("field"))
    return indices.unionByName(fields, allowMissingColumns=True).orderBy("group_id", "member", "idx", "signal", "key")


def cross_version_intent(question: Column, m: Markers = Markers()) -> Column:
    """The question asks for a comparison across versions or files."""
    q = squash(question)
    versions = F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(VERSION_MARK), F.lit(1))))
    return _any(q, m.cross) | (_any(q, m.compare) & (_any(q, m.scope) | (versions >= 2)))


def row_slot_intent(question: Column, m: Markers = Markers()) -> Column:
    """The question asks about two entries in one slot."""
    q = squash(question)
    return _any(q, m.slot) | (
        _any(q, m.slot_context) & (q.rlike(m.weekday) | q.rlike("(?U)" + m.period)) & _any(q, m.slot_query)
    )


def planning_guard(question: Column, markers: tuple[str, ...] = PLANNING_MARKERS) -> Column:
    return F.when(_any(F.coalesce(question, F.lit("")), markers), F.lit("planning_unavailable"))


def activation(has_cross: Column, has_slot: Column, cross_intent: Column, slot_intent: Column) -> tuple[Column, Column]:
    """(activated, suppression reason) for the signals found and the intent expressed."""
    no = F.lit(False)
    c, s = F.coalesce(has_cross, no), F.coalesce(has_slot, no)
    active = F.when(c & s, cross_intent | slot_intent).when(s, slot_intent).when(c, cross_intent).otherwise(no)
    reason = F.when((c | s) & ~active, F.when(c & s, SUPPRESSED_BOTH).when(s, SUPPRESSED_SLOT).otherwise(SUPPRESSED_CROSS))
    return active, reason


def question_mentions(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """Per question: does its text contain one of its own conflicting keys."""
    j = questions.join(keys.select("group_id", squash(F.col("key")).alias("k")).distinct(), "group_id", "left")
    hit = (F.col("k") != "") & F.contains(squash(F.col("question")), F.col("k"))
    return j.groupBy("group_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("mentions_field"))


def distinct_versions(evidence: DataFrame) -> DataFrame:
    v = evidence.where(F.coalesce("version", F.lit("")) != "").select("group_id", "version").distinct()
    return v.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_versions"))
