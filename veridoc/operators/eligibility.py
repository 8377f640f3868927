"""Which chunks may be returned: eligibility, filters, hydration, source lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_FIELDS = ("major", "grade_year", "semester", "doc_category")


def eligible(
    chunks: DataFrame, documents: DataFrame, state: DataFrame, pointer: DataFrame, pipeline_fp: str
) -> DataFrame:
    """Chunks of live, ready, retrievable, completed documents: plain uploads or the active dataset.

    The pointer holds at most one row and enters as scalars.
    """
    p = pointer.agg(F.min("dataset_version").alias("v"), F.min("pipeline_fp").alias("f"))
    version, fp = p.select("v").scalar(), p.select("f").scalar()
    base = (~F.col("deleted")) & (F.col("status") == "ready") & F.col("retrievable")
    upload = (F.col("source_type") == "upload") & F.col("activation_state").isNull()
    demo = (
        (F.col("source_type") == "demo") & (F.col("activation_state") == "active")
        & (F.col("dataset_version") == version) & (fp == F.lit(pipeline_fp))
    )
    docs = documents.where(base & (upload | demo))
    done = state.where("stage = 'completed'").select("doc_id")
    return chunks.join(docs.join(done, "doc_id", "left_semi"), "doc_id")


def filters(**wanted) -> Column:
    """Exact AND filter; unknown keys are refused, blanks ignored."""
    unknown = set(wanted) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"unknown filter: {sorted(unknown)}")
    out = F.lit(True)
    for key in FILTER_FIELDS:
        value = wanted.get(key)
        if value is None or str(value).strip() == "":
            continue
        out = out & (F.col(key) == (int(value) if key == "grade_year" else str(value).strip()))
    return out


def hydrate(hits: DataFrame, eligible_chunks: DataFrame, json_cols: dict[str, str]) -> DataFrame:
    """Re-check candidates and attach columns; unreadable JSON becomes an empty struct."""
    out = hits.join(eligible_chunks, "chunk_id")
    for name, schema in json_cols.items():
        out = out.withColumn(name, F.coalesce(F.from_json(F.col(name), schema), F.from_json(F.lit("{}"), schema)))
    return out


def filter_options(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct non-empty values per field as (field, value) rows, from one pass.

    Values combine map-side before the exchange.
    """
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    )
    return (
        chunks.select(F.explode(pairs).alias("p")).select("p.field", "p.value")
        .where("value IS NOT NULL AND value <> ''").distinct()
    )


def source_lookup(
    wanted: DataFrame, eligible_chunks: DataFrame, chunks: DataFrame, fallback_docs: DataFrame,
    references: list[DataFrame],
) -> DataFrame:
    """Wanted chunk ids that are eligible, else fallback chunks some reference table points to."""
    ids = wanted.select("chunk_id").distinct()
    direct = eligible_chunks.join(ids, "chunk_id", "left_semi").select("chunk_id", "doc_id", F.lit("eligible").alias("via"))
    refs = references[0].select("chunk_id")
    for extra in references[1:]:
        refs = refs.unionByName(extra.select("chunk_id"))
    fall = (
        chunks.join(ids, "chunk_id", "left_semi")
        .join(fallback_docs.select("doc_id"), "doc_id", "left_semi")
        .join(refs.distinct(), "chunk_id", "left_semi")
        .join(direct, "chunk_id", "left_anti")
        .select("chunk_id", "doc_id", F.lit("referenced").alias("via"))
    )
    return direct.unionByName(fall)
