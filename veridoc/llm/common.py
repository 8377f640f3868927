"""Helpers shared by the operators: staged tables, sorted-group streams, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.session import FEW_ROWS, checkpoint_root, shuffled

BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = f"{checkpoint_root(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that a run of long texts doesn't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns of these names (in either case) renamed, and their old names with the new ones."""
    clashing = {n.lower() for n in names}
    taken = clashing | {c.lower() for c in df.columns}
    moved: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in clashing:
            new = f"kept_{len(moved)}"
            while new in taken:
                new += "_"
            taken.add(new)
            moved[c] = new
    return df.withColumnsRenamed(moved), moved


def put_back(df: DataFrame, moved: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in moved.items()})


def fold(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows with different keys, in the order of the keys' hash.

    A hash threshold set by the table's count lets about half as many again through, so the tasks hand
    on a number of rows that doesn't grow with the table before the least are taken.
    """
    span = 1 << 40
    share = min(1.0, (1.5 * rows + 50) / max(df.count(), 1))
    thin = df.withColumn("_sampled", F.pmod(key, F.lit(span))).filter(F.col("_sampled") < int(share * span)).dropDuplicates(["_sampled"])
    return thin.orderBy("_sampled").limit(rows).drop("_sampled")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Runs of equal keys from a sorted stream: (columns, group starts), always with whole groups.

    Only the open last group is carried from batch to batch, so memory follows one batch and one group.
    """
    carry: dict[str, np.ndarray] | None = None
    for batch in batches:
        cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if carry is not None:
            cols = {n: np.concatenate([carry[n], cols[n]]) for n in cols}
        size = len(next(iter(cols.values())))
        if not size:
            continue
        change = np.zeros(size, bool)
        change[0] = True
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(change)
        last = starts[-1]
        carry = {n: c[last:] for n, c in cols.items()}
        if last:
            yield {n: c[:last] for n, c in cols.items()}, starts[:-1]
    if carry is not None:
        yield carry, np.zeros(1, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (a, b); the component is its smallest node.

    Alternating large and small stars: every round is two grouped minima and their joins, staged in
    the shared folder. Minima are combined before the shuffle and the joins may be split by adaptive
    execution, so the centre of a large star is no bottleneck. Nodes without an edge don't appear.
    Minima, at most two for each edge counted, are broadcast only where these are few.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())

    both_ways = F.col("a") != F.col("b")
    current = staged(edges.filter(both_ways).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = state(current)
    while mark[0]:
        minima = F.broadcast if 2 * mark[0] <= FEW_ROWS else shuffled
        ends = current.select(F.explode(F.array(
            F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )).alias("e")).select("e.*")
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ends.filter("v > u").join(minima(least), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(minima(floor), "hi")
        small = (
            pairs.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(floor.select("hi", F.col("m").alias("lo"))).distinct()
        )
        current = staged(small)
        before, mark = mark, state(current)
        if mark == before:
            break
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
