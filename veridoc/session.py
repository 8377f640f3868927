"""Session helper and the table loader shared by the query catalogue."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def build_session(app: str = "veridoc", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    ``spark.checkpoint.dir`` names it. Only where nothing is set and all tasks run on this
    machine (tests) a fresh temporary folder is used; a cluster without one is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


SPLITS_ENOUGH = 4  # splits per core above which a table counts as dealt out


def spread(df: DataFrame) -> DataFrame:
    """Deal a table whose rows lie in fewer input splits than there are cores out to all of them.

    Text work is bound by CPU. A row group is read by one task however many splits its file is cut into, so the
    splits that do hold rows are counted, without reading a column. What is shuffled is at most one split per core; a
    table of many splits is returned unchanged on any cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= SPLITS_ENOUGH * cores:
        return df
    filled = df.select(F.input_file_name(), F.input_file_block_start()).distinct().count()
    return df if filled >= cores else df.repartition(cores)


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a join side that grows with the input: both sides are shuffled and none goes through the driver.

    The planner takes a side for small by the size of its files or compressed blocks. These say little of rows that
    an explode multiplies or that compress well, and a broadcast has to hold all of them in the driver's memory.
    """
    return df.hint("merge")


FEW_ROWS = 200_000  # rows of a few columns that the driver can hold


def few(df: DataFrame) -> DataFrame:
    """Mark a join side by its counted rows: broadcast where they are few, else shuffled."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else shuffled(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A short result that several joins read, stored once in the shared folder instead of made again by each."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, name: str, value: Column, *keep: str | Column) -> DataFrame:
    """``keep`` and a computed column, evaluated once per row whatever reads it.

    The planner guards a generator over an array by filters on that array and moves them to the scan: a computed array is
    then made several times, and before its rows are dealt out. A generator over a plain list of one is left alone.
    """
    return df.select(*keep, F.explode(F.array(value)).alias(name))


class Tables:
    """Attribute access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def wide(self, name: str) -> DataFrame:
        """A table for CPU-bound row work."""
        return spread(getattr(self, name))

    def stream(self, name: str) -> DataFrame:
        """The table as a stream of its files, whether it is one file or a folder of many."""
        schema = getattr(self, name).schema
        # a glob, because a stream over a plain path wants a folder
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")
