"""Sources and sinks: file scan, manifest check, case files, replace-writes, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions import jsonx as jx
from veridoc.functions import text as tx
from veridoc.functions.digest import sha256
from veridoc.session import checkpoint_root

# --- fixed values -----------------------------------------------------------
FILE_TYPES = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx"}
PATH_PREFIX = "corpus/"
MANIFEST_REASONS = (
    "fictional_not_true", "dataset_version_mismatch", "documents_missing", "document_entry_invalid",
    "documents_not_sorted", "duplicate_paths", "dataset_sha256_mismatch", "path_outside_corpus",
    "unsafe_path", "manifest_file_missing", "file_type_extension_mismatch", "checksum_mismatch",
    "corpus_file_set_mismatch",
)
# --- end of fixed values ----------------------------------------------------

MANIFEST_SCHEMA = (
    "dataset_version string, fictional boolean, dataset_sha256 string, documents array<struct<"
    "path:string,sha256:string,file_type:string,doc_category:string,title:string,version:string,"
    "effective_from:string>>"
)
LOCATOR_SCHEMA = (
    "struct<path:string,page_number:int,sheet_name:string,row_start:int,row_end:int,section_title:string>"
)
CASE_SCHEMA = (
    "id string, category string, question string, expected_answer_facts array<string>, "
    f"expected_source_paths array<string>, expected_locators array<{LOCATOR_SCHEMA}>, "
    f"required_evidence_groups array<array<{LOCATOR_SCHEMA}>>, should_refuse boolean, conflict_expected boolean"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, file_type) of every file below a folder."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        "path", F.col("length").alias("size"), sha256(F.col("content")).alias("sha256"),
        extension(F.col("path")).alias("file_type"),
    )


def dataset_digest(documents: Column) -> Column:
    """Digest over ``path LF sha256 LF`` of a manifest's own document array."""
    lines = F.transform(documents, lambda d: F.concat(d["path"], F.lit("\n"), F.coalesce(d["sha256"], F.lit("")), F.lit("\n")))
    return sha256(F.array_join(lines, ""))


def manifest_head_reason(expected_version: str | Column) -> Column:
    """First reason that the manifest row itself is invalid; the version is a value, or a column of the manifest."""
    docs = F.col("documents")
    paths = F.transform(docs, lambda d: d["path"])
    return (
        F.when(~F.coalesce("fictional", F.lit(False)), "fictional_not_true")
        .when(~F.coalesce(F.col("dataset_version") == expected_version, F.lit(False)), "dataset_version_mismatch")
        .when(F.coalesce(F.size(docs), F.lit(0)) < 1, "documents_missing")
        .when(F.exists(paths, lambda p: p.isNull()), "document_entry_invalid")
        .when(paths != F.array_sort(paths), "documents_not_sorted")
        .when(F.size(F.array_distinct(paths)) != F.size(paths), "duplicate_paths")
        .when(~F.coalesce(dataset_digest(docs) == F.col("dataset_sha256"), F.lit(False)), "dataset_sha256_mismatch")
    )


def entry_reasons(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Reason per manifest entry or unlisted file; null when the entry is fine.

    entries (dataset_version, path, sha256, file_type), files (dataset_version, path, sha256).
    """
    e = entries.withColumn("listed", F.lit(True))
    f = files.select("dataset_version", "path", F.col("sha256").alias("disk_sha"), F.lit(True).alias("on_disk"))
    j = e.join(f, ["dataset_version", "path"], "full_outer")
    path = F.col("path")
    reason = (
        F.when(F.col("listed").isNull(), "corpus_file_set_mismatch")
        .when(~F.startswith(path, F.lit(PATH_PREFIX)), "path_outside_corpus")
        .when(path.rlike(r"\\") | F.contains(path, F.lit("..")), "unsafe_path")
        .when(F.col("on_disk").isNull(), "manifest_file_missing")
        .when(
            ~extension(path).isin(*FILE_TYPES) | (extension(path) != F.col("file_type")),
            "file_type_extension_mismatch",
        )
        .when(F.col("disk_sha") != F.col("sha256"), "checksum_mismatch")
    )
    return j.select("dataset_version", "path", reason.alias("reason"))


def first_reasons(reasons: DataFrame) -> DataFrame:
    """First failing reason per dataset: entry problems in path order, an unlisted file last."""
    r = F.col("reason")
    position = F.struct(
        F.when(r == "corpus_file_set_mismatch", 1).otherwise(0).alias("late"), F.col("path")
    )
    return reasons.groupBy("dataset_version").agg(
        F.count(F.lit(1)).alias("n_entries"), F.count(r).alias("n_bad"),
        F.min_by(r, F.when(r.isNotNull(), position)).alias("reason"),
    )


def validate_manifest(manifest: DataFrame, files: DataFrame, expected_version: str | Column) -> DataFrame:
    """Head checks first, then entries against the scanned files."""
    head = manifest.select("dataset_version", manifest_head_reason(expected_version).alias("head_reason"))
    entries = manifest.select("dataset_version", F.explode_outer("documents").alias("d")).where("d IS NOT NULL").select(
        "dataset_version", "d.path", "d.sha256", "d.file_type"
    )
    body = first_reasons(entry_reasons(entries, files))
    return head.join(body, "dataset_version", "left").select(
        "dataset_version", F.coalesce("head_reason", "reason").alias("reason")
    )


def _every(v: Column, check) -> Column:
    """A JSON list whose elements all pass; anything else does not."""
    return jx.is_list(v) & F.coalesce(F.forall(jx.elements(v), check), F.lit(False))


def _objects(v: Column) -> Column:
    return _every(v, jx.is_object)


def _texts(v: Column) -> Column:
    return _every(v, lambda x: (jx.kind(x) == "STRING") & (F.trim(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))) != ""))


def _groups(v: Column) -> Column:
    """Groups of evidence: a list, possibly empty, of non-empty lists of objects."""
    return _every(v, lambda g: _objects(g) & (F.size(jx.elements(g)) > 0))


def parse_cases(lines: DataFrame, value: str = "value", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """One JSON object per line -> fields plus the first validation problem.

    The columns of ``order`` tell lines apart and say which of two cases with one id comes first. The types are checked on the raw JSON: a text in place
    of a boolean or list is a problem, not a null.
    """
    schema = CASE_SCHEMA + ", _corrupt string"
    raw = F.col(value)
    parsed = lines.where(F.trim(value) != "").withColumn(
        "c", F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )

    def blank(field: str) -> Column:
        return F.coalesce(F.trim(F.col(f"c.{field}")), F.lit("")) == ""

    # types come from the raw JSON, read once per line
    def shapes(v: Column) -> Column:
        return F.struct(
            v.isNull().alias("unreadable"), jx.is_object(v).alias("is_object"),
            jx.kind(jx.member(v, "$.id")).alias("id"), jx.is_list(jx.member(v, "$.expected_source_paths")).alias("paths"),
            jx.kind(jx.member(v, "$.should_refuse")).alias("refuse"), _groups(jx.member(v, "$.required_evidence_groups")).alias("groups"),
            _texts(jx.member(v, "$.supporting_answer_facts")).alias("facts"), _texts(jx.member(v, "$.supporting_source_paths")).alias("sources"),
            _objects(jx.member(v, "$.supporting_locators")).alias("locators"),
            jx.kind(jx.member(v, "$.conflict_expected")).alias("conflict"), jx.has(v, "conflict_expected").alias("has_conflict"),
        )

    # a generator: the checks below then read the shapes instead of working them out once each
    parsed = parsed.select("*", F.explode(F.array(tx.let(jx.strict_json(raw), shapes))).alias("_s"))
    paths = F.col("c.expected_source_paths")
    problem = (
        F.when(F.col("_s.unreadable"), "not_json")
        .when(~F.col("_s.is_object"), "not_object")
        .when(blank("id") | (F.col("_s.id") != "STRING"), "bad_id")
        .when(blank("category"), "bad_category")
        .when(blank("question"), "bad_question")
        .when(
            ~F.col("_s.paths")
            | F.coalesce(F.exists(paths, lambda p: F.coalesce(F.trim(p), F.lit("")) == ""), F.lit(False)),
            "bad_expected_source_paths",
        )
        .when(~F.col("_s.groups"), "bad_required_evidence_groups")
        .when(~F.col("_s.facts"), "bad_supporting_answer_facts")
        .when(~F.col("_s.sources"), "bad_supporting_source_paths")
        .when(~F.col("_s.locators"), "bad_supporting_locators")
        .when(F.col("_s.refuse") != "BOOLEAN", "bad_should_refuse")
        .when(F.col("_s.has_conflict") & (F.col("_s.conflict") != "BOOLEAN"), "bad_conflict_expected")
    )
    checked = parsed.select(*order, "c.*", problem.alias("problem")).drop("_corrupt")
    copies = checked.where("problem IS NULL").groupBy(F.trim("id").alias("_id")).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        checked.join(copies, F.trim(checked["id"]) == copies["_id"], "left")
        .withColumn(
            "problem",
            F.when(F.col("problem").isNull() & (F.struct(*order) != F.col("_first")), "duplicate_id").otherwise(F.col("problem")),
        )
        .drop("_id", "_first")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): every line with its number in its own file, from 1, however files are split.

    A file's splits are read by different tasks. Lines are counted per split, the counts of the splits before are
    summed within each file (a window over splits, not lines), and a line adds its place in its split. The lines are stored
    once in the shared folder, so that both passes see the same splits even if executors come or go in between.
    """
    stored = f"{checkpoint_root(spark)}/lines-{uuid.uuid4().hex}"
    spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), "value",
    ).write.parquet(stored)
    lines = spark.read.parquet(stored)
    splits = lines.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_start", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    return lines.join(offsets, ["file", "_start"]).select("file", (F.col("_at") + F.col("_offset")).alias("line_no"), "value")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case files as rows; of two cases with one id, the first by file and line counts."""
    return parse_cases(numbered_lines(spark, path), order=("file", "line_no"))


def empty_case_set(cases: DataFrame) -> DataFrame:
    """One row with whether a case file holds no case at all."""
    return cases.agg((F.count(F.lit(1)) == 0).alias("empty"))


def write_replace(current_path: str, new: DataFrame, target_path: str, key: str) -> DataFrame:
    """Write the next snapshot: documents of ``new`` replace their old rows. The old folder stays.

    A reader switches by publishing the target path, so a failed write leaves no partial state.
    """
    from veridoc.operators.indexstate import replace_rows

    spark = new.sparkSession
    current = spark.read.parquet(current_path)
    replace_rows(current, new, key).write.mode("overwrite").parquet(target_path)
    return spark.read.parquet(target_path)


def report_rows(cases: DataFrame, doubles: list[str], digits: int = 4) -> DataFrame:
    """One JSON text per case, doubles rounded, fields in alphabetical order."""
    cols = [
        (F.round(c, digits) if c in doubles else F.col(c)).alias(c) for c in sorted(cases.columns)
    ]
    return cases.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_report(cases: DataFrame, doubles: list[str], path: str) -> None:
    report_rows(cases, doubles).write.mode("overwrite").text(path)
