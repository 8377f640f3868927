"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A fingerprint of 64 bits is read as four segments of 16 bits. Two fingerprints that differ in at
most four bits meet in one of three ways, by counting how the differing bits fall on the segments:

* two segments are equal: the key is those two segments;
* just one is equal, so the other three differ in one or two bits each: the key is the equal segment
  and a codeword near its neighbour segment. Each side decodes the 17 words within one bit of its
  segment; words two bits apart have such a word in common, so they have a codeword in common;
* none is equal, so each differs in one bit: the key is a codeword near the first segment, and the
  byte without the error of the second and of the third.

The code is perfect, so decoding is a lookup of the syndrome. Every key has at least 28 bits, pairs
that meet are verified by counting bits, and no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import bounded_batches, components, put_back, set_aside, sorted_groups, staged, text_bytes
from veridoc.session import shuffled

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
BLOCK = 1024
GENERATOR = 0b110001110101  # of the (23, 12) Golay code, fixed value


# --- fingerprints -----------------------------------------------------------------------------

def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Majority bits of the shingle hashes as a signed 64-bit integer; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, (ends[width - 1:] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at:at + (1 << 14)]
        hashes = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, digest of the text, fp) for every row; a null text has no words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in text_bytes(batch.column(2))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "digest", "fp"])

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, digest long, fp long")


# --- keys -------------------------------------------------------------------------------------

def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: the remainder of polynomial division by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@lru_cache(maxsize=1)
def near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word the sorted codeword indices of the 17 words within one bit, and which are new."""
    errors = [0] + [1 << i for i in range(23)]
    errors += [1 << i | 1 << j for i in range(23) for j in range(i)]
    errors += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    leaders = np.array(errors)
    error_of = np.zeros(1 << 11, np.int64)
    error_of[_remainder(leaders)] = leaders
    words = np.arange(1 << 16)
    decoded = (words ^ error_of[_remainder(words)]) >> 11
    near = np.stack([decoded] + [decoded[words ^ (1 << i)] for i in range(16)], axis=1)
    near.sort(axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    return near, fresh


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each key): all keys under which a fingerprint can meet one within the radius."""
    near, fresh = near_codewords()
    u = fps.view(np.uint64)
    seg = [(u >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    rows = np.arange(len(fps))
    keys, owners, rule = [], [], 0

    def put(payload: np.ndarray, owner: np.ndarray) -> None:
        nonlocal rule
        keys.append(payload | rule << 40)
        owners.append(owner)
        rule += 1

    for i in range(4):
        for j in range(i):
            put(seg[i] << 16 | seg[j], rows)
    for i in range(4):
        at, col = np.nonzero(fresh[seg[(i + 1) % 4]])
        put(seg[i][at] << 12 | near[seg[(i + 1) % 4][at], col], at)
    at, col = np.nonzero(fresh[seg[0]])
    code = near[seg[0][at], col] << 16
    for a in (0, 8):
        for b in (0, 8):
            put(code | (seg[1][at] >> a & 255) << 8 | (seg[2][at] >> b & 255), at)
    return np.concatenate(keys), np.concatenate(owners)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 4096):
            part = fps[at:at + 4096]
            keys, owner = fuzzy_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owner])], ["key", "fp"])


# --- links ------------------------------------------------------------------------------------

def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one block; a search that visits each member once."""
    left = np.ones(len(fps), bool)
    edges = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack and left.any():
            x = stack.pop()
            open_ = np.flatnonzero(left)
            found = open_[np.bitwise_count(fps[open_] ^ fps[x]) <= radius]
            left[found] = False
            stack.extend(found.tolist())
            edges.extend((x, y) for y in found.tolist())
    return edges


def _block_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in sorted_groups(batches, ["key", "i", "j"]):
            fps = cols["fp"]
            a, b = [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(fps)]):
                group = fps[lo:hi]
                for x, y in forest(group.view(np.uint64), radius):
                    a.append(group[x])
                    b.append(group[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect exactly what the links within ``radius`` connect.

    ``classes`` has one row per different fingerprint ``fp``. A key with two members is settled by its
    least and greatest member. The members of any larger key are dealt into blocks of about ``block``
    by hash and each pair of blocks is one group, so that no task holds a large key and none emits
    its pairs: a group gives a spanning forest of its links. The planner takes the keys, of which a
    fingerprint has over a hundred, to be as many as the classes, so their join is marked as one of
    two large sides.
    """
    if radius > RADIUS:
        raise ValueError(f"the keys cover a radius of {RADIUS}")
    keys = classes.select("fp").mapInArrow(_key_rows, "key long, fp long")
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    met = staged(met)
    pairs = met.filter("n = 2").select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    dealt = (
        keys.join(shuffled(met.filter("n > 2").select("key", "n")), "key").withColumn("g", blocks).withColumn("own", own)
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    found = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_block_links(radius), "a long, b long")
    return pairs.unionByName(found)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, digest, fp, component_id) for every row of ``docs``; ``digest`` tells texts apart.

    ``component_id`` is the least id that chains of links reach, the row's own included. Exact copies
    are joined before anything is paired. Null or empty texts have fingerprint zero and link like any
    other. A null id never becomes a component's id; a component whose ids are all null has a null
    one. Rows that share an id each get a row. An empty table gives an empty result. Other columns of
    ``docs`` are not looked at.
    """
    return _named(docs, id_column, text, radius).drop("component")


def _named(docs: DataFrame, id_column: str, text: str, radius: int) -> DataFrame:
    """The rows of ``near_duplicates`` with their component's least fingerprint, which names it also where ids repeat."""
    prints = staged(fingerprints(docs, id_column, text))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = staged(components(links(classes, radius)))
    linked = grouped.join(shuffled(classes.withColumnRenamed("fp", "node")), "node")
    named = linked.groupBy("component").agg(F.min("least").alias("reach"))
    reach = grouped.join(shuffled(named), "component").select(F.col("node").alias("fp"), "component", "reach")
    ids = classes.join(shuffled(reach), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("reach", "least").alias("component_id"))
    return prints.join(shuffled(ids), "fp").select("doc_id", "digest", "fp", "component_id", "component")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: the least id, null last, then the least digest of the text.

    Of rows equal in both, the one with the least hash of its columns is kept (a column that holds maps counts by its JSON).
    Rows without words are linked like any others, an empty table stays empty and columns of any name are kept.
    """
    found = _named(docs, id_column, text, radius)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    keep = found.groupBy("component").agg(F.min(first).alias("_m")).select(F.col("_m.doc_id").alias("_kept_id"), F.col("_m.digest").alias("_kept_digest"))
    rows, moved = set_aside(docs, ("_kept_id", "_kept_digest"))
    id_of, digest = F.col(moved.get(id_column, id_column)).cast("long"), F.xxhash64(moved.get(text, text))
    kept = rows.join(shuffled(keep), id_of.eqNullSafe(F.col("_kept_id")) & (digest == F.col("_kept_digest")), "left_semi")
    order = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in rows.dtypes])
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    alone = kept.groupBy(id_of.alias("_i"), digest.alias("_d")).agg(F.min_by(row, order).alias("_row"))
    return put_back(alone.select("_row.*"), moved)
