"""Index state: registration, checkpoints, reconciliation, activation, snapshots.

All set comparisons are joins on (doc_id, chunk_id) followed by conditional counts, so
they combine map-side and never gather a document's ids in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.digest import sha256, stable_digest
from veridoc.operators import digesttree as dt

# --- fixed values -----------------------------------------------------------
STAGES = (
    "none", "validated", "stored", "parsed", "chunked", "vector_indexed", "keyword_indexed", "completed",
)
FINGERPRINTS = ("parser", "normalization", "chunker", "embedding", "vector_schema", "keyword_schema")
ACTIVATION_REASONS = (
    "missing_document", "failed_document", "stage_incomplete", "count_mismatch",
    "chunk_set_mismatch", "keyword_set_mismatch", "vector_set_mismatch",
)
# --- end of fixed values ----------------------------------------------------
RANK = {name: i for i, name in enumerate(STAGES)}


def stage_rank(stage: Column) -> Column:
    out = F.when(stage == STAGES[0], 0)
    for i, name in enumerate(STAGES[1:], start=1):
        out = out.when(stage == name, i)
    return F.coalesce(out, F.lit(0))


def stage_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STAGES]), rank + 1)


def locator_types(file_type: Column, block_count: Column) -> Column:
    """Locator fields a document of this type can carry."""

    def names(*values: str) -> Column:
        return F.array(*[F.lit(v) for v in values])

    return (
        F.when(block_count <= 0, F.array().cast("array<string>"))
        .when(file_type == "pdf", names("page_number", "section_title"))
        .when(file_type == "docx", names("section_title"))
        .otherwise(names("sheet_name", "row_start", "row_end"))
    )


def next_status(stage: Column) -> Column:
    """Public status shown for a completed stage."""
    return (
        F.when(stage == "completed", "ready").when(stage == "stored", "parsing")
        .when(stage == "validated", "storing").otherwise("queued")
    )


def error_struct(code: Column, message: Column, retryable: Column) -> Column:
    return F.when(
        F.coalesce(code, F.lit("")) != "",
        F.struct(code.alias("code"), message.alias("message"), F.coalesce(retryable, F.lit(False)).alias("retryable")),
    )


# --- registration (S3) and replacement (S4, S5) ------------------------------

def register(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """Disposition of each incoming (row_id, source_type, sha256).

    ``documents`` is (doc_id, source_type, sha256, status, error_retryable, created_at, deleted).
    The newest live row of a digest decides; inside a batch the first row creates the
    document and its copies attach to it.
    """
    key = ["source_type", "sha256"]
    latest = documents.where("NOT deleted").groupBy(*key).agg(
        F.max_by(F.struct("doc_id", "status", "error_retryable"), F.struct("created_at", "doc_id")).alias("d")
    )
    first = batch.groupBy(*key).agg(F.min("row_id").alias("first_row"))
    # the per-digest side has one row per key; a hot digest is skewed only on the batch side
    facts = first.join(latest, key, "left")
    joined = batch.join(facts, key)
    return joined.select(
        "row_id", *key,
        F.coalesce("d.doc_id", "first_row").alias("doc_id"),
        F.when(F.col("d").isNull(), F.when(F.col("row_id") == F.col("first_row"), "created").otherwise("attached"))
        .when(F.col("d.status") == "ready", "existing_ready")
        .when((F.col("d.status") == "failed") & F.coalesce("d.error_retryable", F.lit(False)),
              F.when(F.col("row_id") == F.col("first_row"), "retry_started").otherwise("attached"))
        .when(F.col("d.status") == "failed", "rejected")
        .otherwise("attached").alias("disposition"),
    )


def replace_rows(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the documents in ``new`` replace the current ones."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_documents(tables: Mapping[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Child tables without the deleted documents."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def tombstone(documents: DataFrame, ids: DataFrame, at: Column, key: str = "doc_id") -> DataFrame:
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return (
        documents.join(gone, key, "left")
        .withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))
        .drop("_gone")
    )


# --- fingerprints and stages (I1-I3) -----------------------------------------

def fingerprint_columns(config: Mapping[str, Mapping[str, object]]) -> dict[str, Column]:
    """One digest per configured part plus ``pipeline`` over all of them."""
    def lit_struct(part: Mapping[str, object]) -> Column:
        return F.struct(*[F.lit(part[k]).alias(k) for k in sorted(part)])

    out = {
        name: stable_digest({k: F.lit(v) for k, v in part.items()}) for name, part in config.items()
    }
    out["pipeline"] = stable_digest({name: lit_struct(part) for name, part in config.items()})
    return out


def effective_stage(stage: Column, same: Mapping[str, Column]) -> Column:
    """Earliest stage to repeat; ``same[name]`` says whether a fingerprint still matches."""
    rank = stage_rank(stage)

    def back_to(name: str) -> Column:
        return F.least(rank, F.lit(RANK[name]))

    return stage_name(
        F.when(~(same["parser"] & same["normalization"]), back_to("stored"))
        .when(~same["chunker"], back_to("parsed"))
        .when(~(same["embedding"] & same["vector_schema"]), back_to("chunked"))
        .when(~same["keyword_schema"], back_to("vector_indexed"))
        .otherwise(rank)
    )


def set_facts(chunks: DataFrame, vectors: DataFrame, keyword: DataFrame) -> DataFrame:
    """Per document: sizes of the three id sets and whether they agree.

    Inputs are (doc_id, chunk_id); ``vectors`` and ``keyword`` may carry a boolean
    ``current`` column (all fingerprints up to date).
    """
    def tag(df: DataFrame, name: str) -> DataFrame:
        current = F.col("current") if "current" in df.columns else F.lit(True)
        return df.select("doc_id", "chunk_id", F.lit(name).alias("side"), current.alias("current"))

    rows = tag(chunks, "c").unionByName(tag(vectors, "v")).unionByName(tag(keyword, "k"))

    def has(side: str) -> Column:
        return F.max(F.col("side") == side)

    per_id = rows.groupBy("doc_id", "chunk_id").agg(
        has("c").alias("in_c"), has("v").alias("in_v"), has("k").alias("in_k"),
        F.min(F.when(F.col("side") == "v", F.col("current"))).alias("v_current"),
        F.min(F.when(F.col("side") == "k", F.col("current"))).alias("k_current"),
    )
    return per_id.groupBy("doc_id").agg(
        F.count_if("in_c").alias("n_chunks"),
        F.count_if("in_v").alias("n_vectors"),
        F.count_if("in_k").alias("n_keyword"),
        F.min(F.col("in_c") == F.col("in_v")).alias("vector_set_ok"),
        F.min(F.col("in_c") == F.col("in_k")).alias("keyword_set_ok"),
        F.coalesce(F.min("v_current"), F.lit(True)).alias("vectors_current"),
        F.coalesce(F.min("k_current"), F.lit(True)).alias("keyword_current"),
    )


def set_facts_by_digest(chunks: DataFrame, vectors: DataFrame, keyword: DataFrame) -> DataFrame:
    """``set_facts`` without meeting the ids of documents whose three sets agree.

    One combinable digest per document and set decides that; ids of other documents go through ``set_facts``.
    Ids are unique within each set of a document.
    """
    def tag(df: DataFrame, side: str) -> DataFrame:
        current = F.col("current") if "current" in df.columns else F.lit(True)
        return df.select("doc_id", "chunk_id", current.alias("current"), F.lit(side).alias("side"))

    rows = tag(chunks, "c").unionByName(tag(vectors, "v")).unionByName(tag(keyword, "k"))
    h = dt.row_hash(["chunk_id"], F.lit(True), "")
    per_side = rows.groupBy("doc_id", "side").agg(*dt.digest(h), F.min("current").alias("current"))
    def of(side: str, value: Column) -> Column:
        return F.max(F.when(F.col("side") == side, value))

    packed = F.struct("n", "x", "lo", "hi")
    sides = per_side.groupBy("doc_id").agg(
        *[of(s, packed).alias(s) for s in "cvk"], *[of(s, F.col("current")).alias(f"{s}_current") for s in "vk"]
    )
    agree = sides.where(F.col("c").isNotNull() & F.col("c").eqNullSafe(F.col("v")) & F.col("c").eqNullSafe(F.col("k")))
    n, yes = F.col("c.n"), F.lit(True)
    whole = agree.select(
        "doc_id", n.alias("n_chunks"), n.alias("n_vectors"), n.alias("n_keyword"), yes.alias("vector_set_ok"), yes.alias("keyword_set_ok"),
        F.coalesce("v_current", yes).alias("vectors_current"), F.coalesce("k_current", yes).alias("keyword_current"),
    )
    known = agree.select("doc_id")
    rest = set_facts(*[df.join(known, "doc_id", "left_anti") for df in (chunks, vectors, keyword)])
    return whole.unionByName(rest)


def verified_stage(state: DataFrame, facts: DataFrame) -> DataFrame:
    """Stage confirmed by what is really stored.

    ``state`` is (doc_id, stage, state_sha, file_sha, expected_chunks, vector_count,
    keyword_count, keyword_schema_ok).
    """
    j = state.join(facts, "doc_id", "left")
    n = F.coalesce("n_chunks", F.lit(0))
    rank = stage_rank(F.col("stage"))
    yes = F.lit(True)

    def back_to(name: str) -> Column:
        return F.least(rank, F.lit(RANK[name]))

    vectors_ok = (
        F.coalesce("vector_set_ok", yes) & (F.col("vector_count") == n) & F.coalesce("vectors_current", yes)
    )
    keyword_ok = (
        F.col("keyword_schema_ok") & F.coalesce("keyword_set_ok", yes) & (F.col("keyword_count") == n)
    )
    out = (
        F.when(F.col("state_sha").isNull() | (F.col("state_sha") != F.col("file_sha")), F.lit(0))
        .when((n == 0) | (n != F.col("expected_chunks")), back_to("parsed"))
        .when(rank < RANK["chunked"], rank)
        .when(~vectors_ok, back_to("chunked"))
        .when(rank < RANK["vector_indexed"], rank)
        .when(~keyword_ok, back_to("vector_indexed"))
        .otherwise(rank)
    )
    return j.select("doc_id", "stage", stage_name(out).alias("verified_stage"))


# --- reconciliation (I4-I6) ---------------------------------------------------

def keyword_actions(expected: DataFrame, recorded: DataFrame, fingerprint: Column) -> DataFrame:
    """Action per (doc_id, chunk_id): keep, refresh (delete and insert), insert or delete.

    Digests are compared first; only rows of leaves with a difference are joined, all others are kept as they are.
    """
    key = ["doc_id", "chunk_id"]
    wanted = expected.select(*key)
    stored = recorded.select(*key, F.coalesce(F.col("fingerprint") == fingerprint, F.lit(False)).alias("good"))
    same, e, r = dt.compare(wanted, stored, key, F.lit(True), F.col("good"))
    apart = e.withColumn("wanted", F.lit(True)).join(r, key, "full_outer").select(
        *key,
        F.when(F.col("wanted").isNull(), "delete")
        .when(F.col("good").isNull(), "insert")
        .when(F.col("good"), "keep")
        .otherwise("refresh").alias("action"),
    )
    return same.select(*key, F.lit("keep").alias("action")).unionByName(apart)


def action_counts(actions: DataFrame, by: list[str]) -> DataFrame:
    a = F.col("action")
    return actions.groupBy(*by).agg(
        F.count_if(a.isin("insert", "refresh")).alias("inserted"),
        F.count_if(a.isin("delete", "refresh")).alias("deleted"),
        F.count_if(a == "keep").alias("kept"),
    )


def pending_vectors(expected: DataFrame, stored: DataFrame, current: Column) -> DataFrame:
    """Action per chunk: reuse a current vector, embed a missing or outdated one, drop the rest.

    As in ``keyword_actions``, only rows of leaves with a difference are joined.
    """
    key = ["chunk_id"]
    held = stored.select(*key, current.alias("is_current"))
    same, e, s = dt.compare(expected.select(*key), held, key, F.lit(True), F.coalesce("is_current", F.lit(False)))
    apart = e.withColumn("wanted", F.lit(True)).join(s, key, "full_outer").select(
        *key,
        F.when(F.col("wanted").isNull(), "drop")
        .when(F.col("is_current"), "reuse")
        .otherwise("embed").alias("action"),
    )
    return same.select(*key, F.lit("reuse").alias("action")).unionByName(apart)


def three_way(facts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Documents whose three id sets and the three recorded counts agree."""
    j = facts.join(recorded, "doc_id", "left")
    ok = (
        F.col("vector_set_ok") & F.col("keyword_set_ok")
        & (F.col("expected_chunks") == F.col("n_chunks"))
        & (F.col("vector_count") == F.col("n_chunks"))
        & (F.col("keyword_count") == F.col("n_chunks"))
    )
    return j.select("doc_id", "n_chunks", "n_vectors", "n_keyword", F.coalesce(ok, F.lit(False)).alias("agree"))


# --- activation (I7, I8) -------------------------------------------------------

def activation_check(manifest: DataFrame, documents: DataFrame, state: DataFrame, facts: DataFrame) -> DataFrame:
    """First reason, in manifest order, why a dataset version cannot be activated (null = can).

    manifest (dataset_version, position, source_key), documents (doc_id, source_key,
    status), state (doc_id, stage, expected_chunks, vector_count, keyword_count).
    A missing document outranks every other reason.
    """
    d = manifest.join(documents, "source_key", "left").join(state, "doc_id", "left").join(facts, "doc_id", "left")
    n = F.coalesce("n_chunks", F.lit(0))
    reason = (
        F.when(F.col("doc_id").isNull(), "missing_document")
        .when(F.col("status") == "failed", "failed_document")
        .when(F.col("stage").isNull() | (F.col("stage") != "completed"), "stage_incomplete")
        .when(
            (F.coalesce("expected_chunks", F.lit(0)) <= 0)
            | (F.coalesce("vector_count", F.lit(0)) != F.col("expected_chunks"))
            | (F.coalesce("keyword_count", F.lit(0)) != F.col("expected_chunks")),
            "count_mismatch",
        )
        .when(n != F.col("expected_chunks"), "chunk_set_mismatch")
        .when(~F.coalesce("keyword_set_ok", F.lit(False)), "keyword_set_mismatch")
        .when(~F.coalesce("vector_set_ok", F.lit(False)), "vector_set_mismatch")
    )
    rows = d.select("dataset_version", "position", reason.alias("r"))
    return rows.groupBy("dataset_version").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.when(F.max(F.coalesce(F.col("r") == "missing_document", F.lit(False))), F.lit("missing_document"))
        .otherwise(F.min_by("r", F.when(F.col("r").isNotNull(), F.col("position")))).alias("reason"),
    )


def activate(documents: DataFrame, target: str, allowed: Column, manifest_keys: DataFrame) -> DataFrame:
    """Next state of the document table: target version active, other demo versions retired.

    ``allowed`` (a scalar) keeps the table unchanged when the preconditions failed.
    """
    keys = manifest_keys.select("source_key").distinct().withColumn("_listed", F.lit(True))
    j = documents.join(keys, "source_key", "left")
    live_demo = (F.col("source_type") == "demo") & ~F.col("deleted")
    enter = allowed & live_demo & F.coalesce("_listed", F.lit(False))
    leave = (
        allowed & live_demo & ~F.coalesce("_listed", F.lit(False))
        & (F.col("activation_state") == "active") & (F.col("dataset_version") != target)
    )
    enter, leave = F.coalesce(enter, F.lit(False)), F.coalesce(leave, F.lit(False))
    return j.withColumns(
        {
            "status": F.when(enter, F.lit("ready")).otherwise(F.col("status")),
            "activation_state": F.when(enter, F.lit("active")).when(leave, F.lit("inactive")).otherwise(F.col("activation_state")),
            "retrievable": F.when(enter, F.lit(True)).when(leave, F.lit(False)).otherwise(F.col("retrievable")),
        }
    ).drop("_listed")


def active_pointer(pointer: DataFrame, target: DataFrame, allowed: Column) -> DataFrame:
    """Next pointer table: only the target's row (dataset_version, manifest_sha256, pipeline_fp) where the
    activation is allowed (a scalar), else the pointer as it was.
    """
    cols = ["dataset_version", "manifest_sha256", "pipeline_fp"]
    yes = F.coalesce(allowed, F.lit(False))
    return target.select(*cols).where(yes).unionByName(pointer.select(*cols).where(~yes))


# --- listings and summaries (I9-I12) --------------------------------------------

def list_documents(documents: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Live documents with their block and chunk counts (0 when absent)."""
    b = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("block_count"))
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    zero = F.lit(0).cast("bigint")
    return (
        documents.where("NOT deleted").join(b, "doc_id", "left").join(c, "doc_id", "left")
        .withColumn("block_count", F.coalesce("block_count", zero))
        .withColumn("chunk_count", F.coalesce("chunk_count", zero))
    )


def listing_totals(documents: DataFrame) -> DataFrame:
    live = documents.where("NOT deleted")
    return live.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("retrievable")).alias("retrievable"),
        F.count_if(~F.col("status").isin("ready", "failed")).alias("processing"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def preview(blocks: DataFrame, order: list, limit: int) -> DataFrame:
    """First ``limit`` blocks per document with the total and a truncated flag.

    The rank filter is cut inside the map tasks (row_number <= n), the totals come from a
    map-side count.
    """
    w = Window.partitionBy("doc_id").orderBy(*order)
    head = blocks.withColumn("block_index", F.row_number().over(w)).where(F.col("block_index") <= limit)
    totals = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    return head.join(totals, "doc_id").withColumn("truncated", F.col("total") > limit)


def dataset_status(
    manifest: DataFrame, documents: DataFrame, pointer: DataFrame, expected_version: str,
    manifest_sha: str, pipeline_fp: str, running: bool = False, last_failed: bool = False,
) -> DataFrame:
    """One row: available / ready / failed counts, loaded flag and state by precedence."""
    live = documents.where("NOT deleted AND source_type = 'demo'")
    j = manifest.join(live.select("source_key", "status"), "source_key", "left")
    counts = j.agg(
        F.count(F.lit(1)).alias("available"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    # the pointer table has at most one row; min() makes that a one-row aggregate
    p = pointer.agg(
        F.min("dataset_version").alias("v"), F.min("manifest_sha").alias("m"), F.min("pipeline_fp").alias("f")
    )
    loaded = F.coalesce(
        (p.select("v").scalar() == expected_version) & (p.select("m").scalar() == manifest_sha)
        & (p.select("f").scalar() == pipeline_fp) & (F.col("available") > 0)
        & (F.col("ready") == F.col("available")) & (F.col("failed") == 0),
        F.lit(False),
    )
    return counts.withColumn("loaded", loaded).withColumn(
        "state",
        F.when(F.lit(running), "running").when(F.col("loaded"), "loaded").when(F.col("ready") > 0, "partial")
        .when(F.lit(last_failed), "failed").otherwise("empty"),
    )


def run_summary(items: DataFrame, job: str = "job_id") -> DataFrame:
    """Per job: result counts, final status and rounded progress; a null result is outstanding."""
    r = F.col("result")
    agg = items.groupBy(job).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(r == name).alias(name) for name in ("imported", "resumed", "skipped", "failed")],
        F.count_if(r.isNull()).alias("outstanding"),
    )
    done = F.col("imported") + F.col("resumed") + F.col("skipped") + F.col("failed")
    return agg.withColumn(
        "status",
        F.when(F.col("outstanding") > 0, "failed").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"),
    ).withColumn("progress_percent", F.bround(done * 100 / F.col("total"), 0).cast("int"))


# --- snapshots (I13) -------------------------------------------------------------

def table_snapshot(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """(table, rows, digest): the digest is a sum of row hashes, independent of row order.

    It combines map-side; a sorted digest would pull every id into one task.
    """
    row = F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in cols])
    part = F.conv(F.substring(sha256(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed tables; a side that is missing counts as changed."""
    b = before.select("table", F.col("rows").alias("rows_before"), F.col("digest").alias("digest_before"))
    a = after.select("table", F.col("rows").alias("rows_after"), F.col("digest").alias("digest_after"))
    same = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("digest_before").eqNullSafe(F.col("digest_after"))
    return b.join(a, "table", "full_outer").withColumn("changed", ~same)
