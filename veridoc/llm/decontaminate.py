"""Benchmark decontamination with DataFrame functions alone.

Words are lower-cased runs of letters and digits; a shingle is five words, or the whole item where it is
shorter. A document leaks an item if one of its windows of as many words as the item has a weighted
shingle similarity (sum of least over sum of greatest multiplicities) of at least the threshold.

1. A window that is that similar shares so many shingles with the item that, of every ``stride``-th
   position of the document, one at least holds a shingle of the item. Only windows around such hits
   can leak, and the stride follows from the shortest item and the threshold: nothing is lost.
2. Those windows get a SimHash of their shingle hashes. It is cut into eight blocks; fingerprints
   within the radius agree in some block up to radius // 8 bits, and items are stored under every
   block value that near. This multi-index finds all pairs within the radius.
3. Pairs within the radius are verified exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import let
from veridoc.llm.common import put_back, set_aside, staged
from veridoc.session import shuffled

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 23  # at a similarity of 0.8 fingerprints differ in 10 bits of 64 on average, with deviation 3
BLOCKS = 8
BROADCAST_ROWS = 300_000  # of 40 bytes: an index of so many keys is sent to all tasks, a larger one is shuffled
LANES = 3  # counters of 21 bits in a long: windows of up to two million words
LANE_BITS = 21
_GROUPS = -(-64 // LANES)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def shingles(tokens: Column, width: Column, step: int = 1) -> Column:
    """Array of (position, hash) of the shingles at every ``step``-th position from 0."""
    def of(t: Column) -> Column:
        last = F.size(t) - width
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)),
            lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(t, i + 1, width)).alias("hash")),
        )).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return let(tokens, of)


def simhash(hashes: str) -> Column:
    """Majority bits of a column of 64-bit hashes.

    Bits are counted in lanes of longs: bit b is counted in lane b // _GROUPS of long b % _GROUPS.
    """
    def spread(g: int) -> str:
        return " | ".join(
            f"shiftleft(shiftrightunsigned(h, {g + k * _GROUPS}) & 1L, {k * LANE_BITS})" for k in range(LANES) if g + k * _GROUPS < 64
        )

    def bit(b: int) -> str:
        count = f"(shiftrightunsigned(a.c{b % _GROUPS}, {b // _GROUPS * LANE_BITS}) & {(1 << LANE_BITS) - 1}L)"
        return f"if({count} * 2 > a.n, shiftleft(1L, {b}), 0L)"

    zero = ", ".join(f"0L AS c{g}" for g in range(_GROUPS))
    step = ", ".join(f"a.c{g} + ({spread(g)}) AS c{g}" for g in range(_GROUPS))
    return F.expr(
        f"aggregate({hashes}, struct({zero}, 0L AS n), (a, h) -> struct({step}, a.n + 1L AS n), a -> {' | '.join(map(bit, range(64)))})"
    )


def block_keys(fp: str, errors: int) -> Column:
    """Array of (block, value) of a fingerprint column, with every value within ``errors`` bits of the block's own."""
    size = 64 // BLOCKS
    masks = ",".join(str(sum(1 << b for b in bits)) for n in range(errors + 1) for bits in combinations(range(size), n))
    return F.expr(
        f"flatten(transform(sequence(0, {BLOCKS - 1}), _b -> transform(array({masks}), _m -> "
        f"struct(_b AS block, cast(shiftrightunsigned({fp}, _b * {size}) & {(1 << size) - 1}L AS int) ^ _m AS value))))"
    )


def shared(a: Column, b: Column) -> Column:
    """Sum over different shingles of the lesser multiplicity; a and b are bound."""
    def times(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    plain = F.size(F.array_intersect(a, b))
    single = F.size(F.array_distinct(a)) == F.size(a)
    return F.when(single, plain).otherwise(
        F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    )


def _texts(tokens: Column, width: Column) -> Column:
    return let(tokens, lambda t: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(t) - width, F.lit(0))), lambda i: F.array_join(F.slice(t, i + 1, width), " ")
    ))


def _stride(items: DataFrame, threshold: float) -> int:
    """The widest step at which no similar window can hide from the hits; one figure over all items."""
    m = F.col("n") - F.col("width") + 1
    least = F.ceil(threshold / (1 + threshold) * 2 * m - 1e-9)
    step = F.floor(F.ceil(threshold * m - 1e-9) / (m - least + 1))
    return max(1, int(items.agg(F.min(step)).first()[0] or 1))


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, digest, item_id, start, similarity): each leaked item of each document at its best window.

    ``start`` counts words from 0, the first of equally similar windows is named. Null or empty texts
    and items without a word leak nothing. Items of less than five words are one shingle and leak
    where their words stand together. A document shorter than the item has one window, itself.
    Repeated rows are one document; repeated item ids are separate items with one id, reported once
    at their best. A null id is kept as null. Other columns are not looked at. Texts stay in their
    table: hits are ids and positions, and only documents with a hit are read again.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item")).distinct()
    items = items.withColumn("n", F.size("item")).filter("n > 0").withColumn("width", F.least(F.lit(WIDTH), "n"))
    items = items.withColumn("item_key", F.xxhash64("item_id", "item")).withColumn("hashes", F.transform(shingles(F.col("item"), F.col("width")), lambda s: s["hash"]))
    items = staged(staged(items).withColumn("item_fp", simhash("hashes")))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most five values
    step = _stride(items, threshold)
    known = staged(items.select("n", "width", F.explode(F.array_distinct("hashes")).alias("hash")).distinct())
    known_hashes = staged(known.select("width", "hash").distinct())

    key = [F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest")]
    at_width = [
        f"transform(filter(sequence(0, greatest(size(t) - {w}, 0), {step}), i -> i + {w} <= size(t)), "
        f"i -> struct({w} AS width, i AS pos, xxhash64(slice(t, i + 1, {w})) AS hash))" for w in widths
    ]
    found = f"transform(array(_tokens), t -> struct(size(t) AS total, concat({', '.join(at_width)}) AS all))[0]"
    none = "struct(0 AS total, cast(array() AS array<struct<width:int,pos:int,hash:bigint>>) AS all)"
    placed = docs.select(*key, words(F.col(text)).alias("_tokens")).select("doc_id", "digest", F.expr(found if widths else none).alias("f"))
    hits = placed.select("doc_id", "digest", F.col("f.total").alias("total"), F.explode("f.all").alias("s")).select("doc_id", "digest", "total", "s.*")
    hits = staged(hits.join(known_hashes, ["width", "hash"]).distinct())

    n, total = F.col("n"), F.col("total")
    latest = F.greatest(total - n, F.lit(0))
    first = F.least(F.greatest(F.col("pos") - n + F.col("width"), F.lit(0)), latest)
    starts = hits.join(known, ["width", "hash"]).select(
        "doc_id", "digest", F.explode(F.sequence(first, F.least(F.col("pos"), latest))).alias("start"), "n", "width"
    )
    wanted = starts.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "n", "width")).alias("windows"))
    again = docs.select(*key, F.col(text).alias("_text")).withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))
    cut = again.join(wanted, same).dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", words(F.col("_text")).alias("tokens"), "windows")
    windows = cut.select("doc_id", "digest", "tokens", F.explode("windows").alias("w")).select(
        "doc_id", "digest", "w.*", F.slice("tokens", F.col("w.start") + 1, F.col("w.n")).alias("window")
    )
    hashed = windows.withColumn("hashes", F.transform(shingles(F.col("window"), F.least("width", F.size("window"))), lambda s: s["hash"]))
    printed = hashed.select("doc_id", "digest", "start", "n", "width", "window", F.explode(F.array(simhash("hashes"))).alias("fp"))
    probes = printed.select("*", F.explode(block_keys("fp", 0)).alias("b")).select("*", "b.*").drop("b")
    keyed = items.select("item_key", "n", "item_fp", F.explode(block_keys("item_fp", radius // BLOCKS)).alias("b"))
    index = staged(keyed.select("item_key", "n", "item_fp", "b.*"))
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else shuffled(index)
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = probes.join(index, ["n", "block", "value"]).filter(differ <= radius)
    met = near.groupBy("doc_id", "digest", "start", "item_key").agg(F.first("window").alias("window"), F.first("width").alias("width"))
    pairs = met.join(items.select("item_key", "item_id", "item"), "item_key")
    a, b = _texts(F.col("item"), F.col("width")), _texts(F.col("window"), F.least("width", F.size("window")))
    common = let(a, lambda x: let(b, lambda y: F.struct((F.size(x) + F.size(y)).alias("sizes"), shared(x, y).alias("common"))))
    judged = pairs.select("doc_id", "digest", "item_id", "start", F.explode(F.array(common)).alias("j"))
    similar = judged.withColumn("similarity", F.col("j.common") / (F.col("j.sizes") - F.col("j.common"))).filter(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return similar.groupBy("doc_id", "digest", "item_id").agg(best).select(
        "doc_id", "digest", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item; a row is known by its id and its text.

    Rows without text leak nothing and stay, repeated rows go or stay together, an empty table stays empty and columns of any
    name are kept.
    """
    found = leaks(docs, benchmark, threshold, RADIUS, id_column, text)
    gone = found.select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest")).distinct()
    rows, moved = set_aside(docs, ("_gone_id", "_gone_digest"))
    same = F.col(moved.get(id_column, id_column)).cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(moved.get(text, text)) == F.col("_gone_digest"))
    return put_back(rows.join(gone, same, "left_anti"), moved)
