"""Exact vector top-k: squared L2, batches of queries against the whole vector table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.operators.keyword import RANK_SCALE

DENSE_TOP_K = 12
QUERY_BLOCK = 2048     # queries that meet a cell of vectors at once
CELL_BYTES = 32 << 20  # of vectors in one cell, as doubles
_OUT = "query_id bigint, id bigint, distance double"


def _broken(v: Column) -> Column:
    """Some component is null or not finite."""
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def check_vectors(df: DataFrame, dim: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, reason): null reason for a usable vector, else why it is refused."""
    v = F.col(vec_col)
    return df.select(
        F.col(id_col).alias("id"),
        F.when(v.isNull(), F.lit("missing"))
        .when(F.size(v) != dim, F.lit("dimension_mismatch"))
        .when(_broken(v), F.lit("not_numeric"))
        .alias("reason"),
    )


def usable(df: DataFrame, dim: int, vec_col: str = "v") -> DataFrame:
    """Rows whose vector ``check_vectors`` accepts, as doubles."""
    v = F.col(vec_col)
    return df.where(v.isNotNull() & (F.size(v) == dim) & ~_broken(v)).withColumn(vec_col, v.cast("array<double>"))


def _local_top(q_ids, q_mat, ids, mat, k):
    """k nearest rows of ``mat`` for each query, ties by id, distances at the shared scale."""
    keep_q, keep_i, keep_d = [], [], []
    step = max(1, 4_000_000 // max(1, len(ids)))
    for lo in range(0, len(q_ids), step):
        q = q_mat[lo : lo + step]
        d = (q * q).sum(1)[:, None] + (mat * mat).sum(1)[None, :] - 2.0 * (q @ mat.T)
        d = np.round(np.maximum(d, 0.0), RANK_SCALE)
        for row, qid in enumerate(q_ids[lo : lo + step]):
            cand = np.arange(len(ids))
            if len(ids) > k:
                limit = np.partition(d[row], k - 1)[k - 1]
                cand = np.flatnonzero(d[row] <= limit)
            order = np.lexsort((ids[cand], d[row][cand]))[:k]
            keep_q.append(np.full(len(order), qid))
            keep_i.append(ids[cand[order]])
            keep_d.append(d[row][cand[order]])
    return np.concatenate(keep_q), np.concatenate(keep_i), np.concatenate(keep_d)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _table(q, i, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())],
        names=["query_id", "id", "distance"],
    )


def _cell(k: int):
    """Function over one (queries, vectors) cell of a grid."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_table([], [], [])])
        q_ids, ids = left.column("query_id").to_numpy(), right.column("id").to_numpy()
        out = _local_top(
            q_ids, _matrix(left.column("v"), left.num_rows), ids, _matrix(right.column("v"), right.num_rows), k
        )
        return pa.Table.from_batches([_table(*out)])

    return run


def vector_top_k(
    queries: DataFrame, vectors: DataFrame, dim: int, k: int = DENSE_TOP_K, block: int = QUERY_BLOCK, cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """(query_id, id, distance, score, rank) with score = 1 / (1 + distance).

    Both inputs are (id-like, ``v`` array); vectors and queries that are null, of another length than
    ``dim`` or not finite take no part. The same plan for any number of queries or vectors.
    """
    def one_key(df: DataFrame, id_col: str) -> DataFrame:
        # 0 in every row, but not a literal, which would turn the joins on it into products
        return df.withColumn("_all", F.pmod(F.xxhash64(id_col), F.lit(1)))

    return filtered_top_k(one_key(queries, "query_id"), one_key(vectors, "id"), "_all", dim, k, block, cell_bytes)


def filtered_top_k(
    queries: DataFrame, vectors: DataFrame, key: str, dim: int, k: int = DENSE_TOP_K, block: int = QUERY_BLOCK, cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """Top-k among vectors whose ``key`` equals the query's, filtered before ranking.

    Rows meet on (key, query block, vector slice): a slice holds at most about ``cell_bytes`` of
    vectors, so a key of any size is spread over many tasks and each cell is bounded. The
    numbers of slices and blocks come from counts per key. A cell hands on ids and distances only.
    """
    rows = max(1, cell_bytes // (8 * dim))

    def parts(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("key")).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias(name))

    def upto(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))

    good_v, good_q = usable(vectors, dim), usable(queries, dim)
    sizes = parts(good_v, rows, "n_slices").join(parts(good_q, block, "n_blocks"), "key")
    v = good_v.select(F.col(key).alias("key"), "id", "v").join(sizes, "key").select(
        "key", upto("n_blocks").alias("b"), F.pmod(F.xxhash64("id"), F.col("n_slices")).alias("s"), "id", "v"
    )
    q = good_q.select(F.col(key).alias("key"), "query_id", "v").join(sizes, "key").select(
        "key", F.pmod(F.xxhash64("query_id"), F.col("n_blocks")).alias("b"), upto("n_slices").alias("s"), "query_id", "v"
    )
    local = q.groupBy("key", "b", "s").cogroup(v.groupBy("key", "b", "s")).applyInArrow(_cell(k), _OUT)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        local.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "id", "distance", (1.0 / (1.0 + F.col("distance"))).alias("score"), "rank")
    )


def embed_with(df: DataFrame, id_col: str, text_col: str, embedder, dim: int) -> DataFrame:
    """Run a user's batch embedder ``list[str] -> list[list[float]]`` inside the tasks."""

    def run(frames):
        for pdf in frames:
            vecs = embedder(pdf["text"].fillna("").tolist())
            if len(vecs) != len(pdf) or any(len(x) != dim for x in vecs):
                raise ValueError("embedder returned a wrong count or dimension")
            yield pdf[["id"]].assign(v=[[float(x) for x in vec] for vec in vecs])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {id_type}, v array<double>")
