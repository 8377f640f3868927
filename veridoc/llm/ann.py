"""Nearest neighbours by inner product: multiprobe p-stable hashing.

Inner products become distances by the usual lift: vectors are scaled to the greatest norm m and get the
coordinate sqrt(m^2 - |x|^2), queries get 0, so the nearest point has the greatest inner product. A table
hashes a point by a few Gaussian projections, each cut into bins of one width. A query visits, per
table, the buckets in order of their estimated success: the chance that a neighbour falls into a bin is
a normal interval around the query's own projection, shrunk and spread as fitted on a bounded
sample. It goes on until the chances visited add up to a share that finds enough of the sample's own
neighbours. Bucket members are scored exactly, and the candidates of all tables are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm.common import bounded_batches, bounded_sample, sorted_groups, staged

NEIGHBOURS = 20
TABLES = 4
BUCKET_ROWS = 4096  # rows aimed at per bucket: projections are added as the table grows
BINS = 4  # bins that hold most of a projection
RECALL = 0.96  # share of the sample's neighbours that the visits must find
SUCCESSES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 1.0)
SAMPLE_QUERIES, SAMPLE_ROWS = 256, 8192
LONG = 4.0  # vectors longer than this times the sample's 99th percentile are scored against every query
CHUNK_BYTES = 8 << 20  # of a bucket scored together; a larger bucket is several chunks
QUERY_BLOCK = 256
ROUNDING = 1e-12  # error of a product, as a share of the lengths; candidates this near the cut are scored exactly
EVERYWHERE = -1  # bucket of the long vectors, visited by every query


def directions(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of the vectors, at most the largest finite number."""
    most = np.abs(x).max(1, initial=0)
    scaled = x / np.where(most > 0, most, 1)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(np.einsum("ij,ij->i", scaled, scaled)), np.finfo(np.float64).max)


@dataclass(frozen=True)
class Hashing:
    """Projections (tables, k, dim + 1), offsets (tables, k), the bin width and how neighbours' projections spread."""

    projections: np.ndarray
    offsets: np.ndarray
    width: float
    norm: float
    shrink: float
    spread: float
    bins: int
    success: float

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Points of the unit sphere; lengths are counted in norms, so that no square overflows."""
        if query:
            return np.hstack([directions(x), np.zeros((len(x), 1))])
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))[:, None]])

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        return np.einsum("nd,tkd->tnk", self.lift(x, query), self.projections)

    def cell(self, values: np.ndarray, t: int) -> np.ndarray:
        """Bin of a projection, the outer bins open-ended."""
        return np.clip(np.floor((values + self.offsets[t]) / self.width), 0, self.bins - 1).astype(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows) bucket numbers of stored vectors."""
        power = self.bins ** np.arange(self.projections.shape[1])
        return np.stack([self.cell(v, t) @ power for t, v in enumerate(self.project(x, False))])

    def long(self, x: np.ndarray) -> np.ndarray:
        return lengths(x) > self.norm

    def probes(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(table, query row, bucket) of the visits, best first, until their chances reach ``success``."""
        k = self.projections.shape[1]
        grid = np.array(list(product(range(self.bins), repeat=k)))
        power = self.bins ** np.arange(k)
        edges = np.concatenate([[-np.inf], np.arange(1, self.bins) * self.width, [np.inf]])
        out = []
        for t, v in enumerate(self.project(x, True)):
            cdf = _normal_cdf((edges[None, None, :] - self.offsets[t][None, :, None] - (v * self.shrink)[:, :, None]) / self.spread)
            chance = np.diff(cdf, axis=2)
            joint = np.ones((len(x), len(grid)))
            for j in range(k):
                joint *= chance[:, j, grid[:, j]]
            order = np.argsort(-joint, axis=1, kind="stable")
            ranked = np.take_along_axis(joint, order, 1)
            visit = np.cumsum(ranked, axis=1) - ranked < self.success * ranked.sum(1, keepdims=True)
            row, place = np.nonzero(visit)
            out.append((np.full(len(row), t), row, (grid @ power)[order[row, place]]))
        return out


_erf = np.frompyfunc(math.erf, 1, 1)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(z / math.sqrt(2)).astype(np.float64))


def fit(rows: int, norm: float, sample: np.ndarray, neighbours: int, tables: int = TABLES, recall: float = RECALL, seed: int = 0) -> Hashing:
    """Choose the projections' number by the table's size; fit width, shrink, spread and success on the sample."""
    bins = BINS
    k = max(1, round(math.log(max(rows / BUCKET_ROWS, 1)) / math.log(bins)))
    rng = np.random.default_rng(seed)
    projections = rng.standard_normal((tables, k, sample.shape[1] + 1))
    sample = sample[lengths(sample) <= norm]
    plain = Hashing(projections, np.zeros((tables, k)), 1.0, norm, 1.0, 1.0, bins, 1.0)
    stored = plain.project(sample, False)
    width = max(float(np.subtract(*np.quantile(stored, [0.9, 0.1]))) / (bins - 1), 1e-9)
    offsets = bins * width / 2 - np.median(stored, axis=1)
    queries = sample[: min(SAMPLE_QUERIES, len(sample))]
    scores = directions(queries) @ (sample / norm).T  # neighbours don't depend on the query's length
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    shrink, spread = 1.0, width
    near = max(1, min(len(sample) - 1, round(neighbours * len(sample) / max(rows, 1))))
    if len(sample) > 2:
        best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
        asked = plain.project(queries, True)
        a = np.repeat(asked[:, :, None, :], near, 2).ravel()
        b = stored[:, best, :].ravel()
        shrink = float(a @ b / max(a @ a, 1e-12))
        spread = max(float(np.std(b - shrink * a)), 1e-6)
    for success in SUCCESSES:
        found = Hashing(projections, offsets, width, norm, shrink, spread, bins, success)
        if len(sample) <= 2 or _coverage(found, queries, sample, best) >= recall:
            break
    return found


def _coverage(hashing: Hashing, queries: np.ndarray, sample: np.ndarray, best: np.ndarray) -> float:
    """Share of the known neighbours that lie in a visited bucket of some table."""
    own = hashing.buckets(sample)
    met = np.zeros(best.shape, bool)
    for t, (_, row, bucket) in enumerate(hashing.probes(queries)):
        visited = np.zeros((len(queries), hashing.bins ** hashing.projections.shape[1]), bool)
        visited[row, bucket] = True
        met |= np.take_along_axis(visited, own[t][best], 1)
    return float(met.mean())


def valid(vector: str, dim: int) -> str:
    """SQL for: ``dim`` components, all finite, not all zero."""
    v = f"cast({vector} AS array<double>)"
    finite = "x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')"
    return f"{vector} IS NOT NULL AND size({vector}) = {dim} AND forall({v}, x -> {finite}) AND exists({v}, x -> x <> 0)"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _search(neighbours: int):
    """Score sorted runs of one chunk: its stored vectors come first, then the queries that visit it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts = None, [], []
        stored: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            table, bucket, chunk, side, vec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            matrix = _matrix(batch.column(5))
            change = np.ones(len(side), bool)
            change[1:] = (np.diff(table) != 0) | (np.diff(bucket) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)
            starts = np.flatnonzero(change).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(side)]):
                here = (table[lo], bucket[lo], chunk[lo])
                if here != key:
                    key, ids, parts, stored = here, [], [], None
                if side[lo] == 0:
                    ids.append(vec[lo:hi])
                    parts.append(matrix[lo:hi])
                    continue
                if not ids:
                    continue
                if stored is None:
                    stored = np.concatenate(ids), np.concatenate(parts)
                for at in range(lo, hi, QUERY_BLOCK):
                    yield _best(vec[at:min(hi, at + QUERY_BLOCK)], matrix[at:min(hi, at + QUERY_BLOCK)], *stored, neighbours)

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same sum for equal vectors whatever the block; never NaN.

    Where the sum overflows on the way, it is taken over scaled components: finite if it is, else infinite.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * b).sum(1)
        bad = np.flatnonzero(~np.isfinite(out))
        if len(bad):
            a, b = a[bad], b[bad]
            most_a, most_b = np.abs(a).max(1), np.abs(b).max(1)
            out[bad] = ((a / most_a[:, None]) * (b / most_b[:, None])).sum(1) * np.maximum(most_a, most_b) * np.minimum(most_a, most_b)
    return out


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, neighbours: int) -> pa.RecordBatch:
    other = query_ids[:, None] != ids[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries @ vectors.T
        slack = ROUNDING * lengths(queries)[:, None] * lengths(vectors)[None, :]
        sure = other & np.isfinite(rough) & np.isfinite(slack)
        least = np.full(len(query_ids), -np.inf)
        if len(ids) > neighbours:
            least = np.partition(np.where(sure, rough - slack, -np.inf), -neighbours, axis=1)[:, -neighbours]
        q, v = np.nonzero(other & (~sure | (rough + slack >= least[:, None])))
    score = products(queries[q], vectors[v])
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(q, minlength=len(query_ids)))]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids), pa.ListArray.from_arrays(ends, pa.array(ids[v])), pa.ListArray.from_arrays(ends, pa.array(score))], ["query_id", "ids", "scores"]
    )


def _merge(neighbours: int):
    """Merge the candidates of all visits of a query; rows come sorted by query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in sorted_groups(batches, ["query_id"]):
            out: list[tuple[int, int, int, float]] = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cols["query_id"])]):
                ids, first = np.unique(np.concatenate(cols["ids"][lo:hi]).astype(np.int64), return_index=True)
                scores = np.concatenate(cols["scores"][lo:hi]).astype(np.float64)[first]
                top = np.lexsort((ids, -scores))[:neighbours]
                out += [(int(cols["query_id"][lo]), rank, int(ids[i]), float(scores[i])) for rank, i in enumerate(top, 1)]
            q, rank, vec, score = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "rank", "vec_id", "score"]
            )

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, neighbours: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``neighbours`` found with the largest inner product, ties by id.

    A row's own id is no candidate. Rows whose id is null, or whose vector is null, zero, of another
    length than most, or with a null or non-finite component, take no part. Finite components may have any
    size: vectors much longer than the others are hashed nowhere and scored against every query; a product
    beyond double precision is infinite. Equal vectors beyond the
    ``neighbours`` + 1 least ids can be in no answer and are not indexed; a repeated id keeps one row.
    Queries that see fewer candidates than ``neighbours`` are searched again in all buckets, so each
    answer is full if the table is. An empty table gives no rows. A bucket of any size is dealt into
    chunks, every chunk is scored against the queries that visit it, and a task holds one chunk.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    sizes = vectors.groupBy(F.size(vector).alias("d")).count().filter("d > 0").orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0][0]

    def clean(df: DataFrame) -> DataFrame:
        plain = df.filter(F.col(id_column).isNotNull() & F.expr(valid(f"`{vector}`", dim)))
        return plain.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    alike = Window.partitionBy("v").orderBy("id")
    index = staged(clean(vectors).dropDuplicates(["id"]).withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= neighbours + 1).drop("_n"))
    asked = staged(clean(queries).dropDuplicates(["id"]))
    most = F.expr("aggregate(v, 0D, (a, x) -> greatest(a, abs(x)))")
    length = F.col("_most") * F.sqrt(F.expr("aggregate(v, 0D, (a, x) -> a + (x / _most) * (x / _most))"))
    facts = index.withColumn("_most", most).agg(F.count("*"), F.max(length)).first()
    rows = int(facts[0])
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r[0] for r in bounded_sample(index, F.xxhash64("id", F.lit(7)), SAMPLE_ROWS).select("v").collect()])
    norm = min(facts[1], LONG * float(np.quantile(lengths(sample), 0.99)), np.finfo(np.float64).max)
    hashing = fit(rows, norm, sample, neighbours, tables, recall)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(1))
            long = hashing.long(matrix)
            hashed = np.flatnonzero(~long)
            found = hashing.buckets(matrix[hashed])
            for t in range(tables):
                rows_, bucket = hashed, found[t]
                if t == 0:
                    rows_ = np.concatenate([hashed, np.flatnonzero(long)])
                    bucket = np.concatenate([bucket, np.full(long.sum(), EVERYWHERE)])
                at = pa.array(rows_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows_), t)), pa.array(bucket), batch.column(0).take(at), batch.column(1).take(at)], ["t", "bucket", "id", "v"]
                )

    def visit(everything: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if everything:
                    count = hashing.bins ** hashing.projections.shape[1]
                    row = np.repeat(np.arange(batch.num_rows), count)
                    found = [(np.zeros(len(row), np.int64), row, np.tile(np.arange(count), batch.num_rows))]
                else:
                    found = hashing.probes(_matrix(batch.column(1)))
                rows_ = np.arange(batch.num_rows)
                found.append((np.zeros_like(rows_), rows_, np.full_like(rows_, EVERYWHERE)))
                for t, row, bucket in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t), pa.array(bucket), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["t", "bucket", "id", "v"]
                    )

        return run

    shape = "t long, bucket long, id long, v array<double>"
    placed = index.mapInArrow(store, shape)
    counts = staged(placed.groupBy("t", "bucket").agg(F.count("*").alias("_n")).withColumn("chunks", F.ceil(F.col("_n") * dim * 8 / CHUNK_BYTES).cast("int")).drop("_n"))
    members = placed.join(counts, ["t", "bucket"]).select("t", "bucket", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("side"), "id", "v")

    def answers(who: DataFrame, everything: bool) -> DataFrame:
        visits = who.mapInArrow(visit(everything), shape).join(counts, ["t", "bucket"])
        visits = visits.select("t", "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), "id", "v")
        dealt = members.filter("t = 0") if everything else members
        sorted_ = dealt.unionByName(visits).repartition("t", "bucket", "chunk").sortWithinPartitions("t", "bucket", "chunk", "side")
        found = sorted_.mapInArrow(_search(neighbours), "query_id long, ids array<long>, scores array<double>")
        return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(neighbours), "query_id long, rank int, vec_id long, score double")

    first = staged(answers(asked, False))
    full = first.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min(neighbours, rows - 1)).select(F.col("query_id").alias("id"))
    short = staged(asked.join(full, "id", "left_anti"))
    if short.isEmpty():
        return first
    again = answers(short, True)
    return first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
