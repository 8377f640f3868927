"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import decontaminate, mixing, near_dedup, quality, secrets
from veridoc.llm.common import set_aside, table
from veridoc.session import checkpoint_root


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled rows of ``docs``, accepts.

    A row without text is scored as an empty one. Repeated rows are kept or go together, rows of an equal score too. An
    empty table stays empty. All columns are kept.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group: the least id, null last, then the least digest of text and of the row.

    Texts without words, null ones too, form one group. An empty table stays empty. All columns are kept.
    """
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark.

    Rows without text hold none, repeated rows go together. An empty table, or an empty benchmark, drops nothing. All columns
    are kept.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret in the text replaced; ``n_chars`` follows the text.

    Null texts stay null, whatever the other columns hold stays too. An empty table stays empty.
    """
    clean = secrets.without_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


MIX_COLUMNS = {"_size": "mix_words", "_target": "mix_target", "_taken": "mix_taken", "_copies": "mix_copies", "_position": "mix_position"}


def order_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, in training order, with their words taken, passes and position.

    Rows without words are not taken. Equal rows are interchangeable; a null source is a source. An empty table stays empty.
    All columns are kept, but those with the name of an added ``mix_`` column are replaced.
    """
    rows, moved = set_aside(docs, mixing.ADDED + tuple(MIX_COLUMNS.values()))
    mixed = mixing.in_training_order(mixing.mix(rows).filter("_taken > 0"))
    added = [F.col(c).alias(name) for c, name in MIX_COLUMNS.items()]
    kept = [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns if c.lower() not in MIX_COLUMNS.values()]
    return mixed.select(*kept, *added)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", hide_secrets),
    ("mixing", order_mix),
]

#: A learned classifier, fingerprints and a compressor are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read back."""
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
