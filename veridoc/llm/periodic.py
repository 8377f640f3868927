"""Periodic runs of words by an enhanced suffix array.

A run is a longest stretch of words with a smallest period. Its last square, two equal neighbours of
one period's length, branches: the word after it differs from the word a period before. So it lies at an
LCP interval of just that depth, with its two halves in different children. Every interval takes the suffixes
of all children but the largest and asks the inverse suffix array whether the suffix one depth further on, or
back, lies in the same interval outside the own child. The squares found are rotated to the left as far as
they stay squares, which gives the run, and equal runs merge under the smallest period. Intervals are
index ranges of the LCP array; there is no tree. All steps are array operations over many texts at once,
and the suffix array's doubling ranks also answer how far two places agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import let
from veridoc.llm.common import bounded_batches, text_bytes

LEAST = 6
EXPONENT = 4
CHUNK_WORDS = 200_000  # words whose suffixes are sorted together; a longer text is a chunk of its own
HOPS = 16
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def doubling_ranks(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for every power of two the ranks of the prefixes of that length.

    ``key`` holds numbers that differ between texts, ``end`` the end of each position's text. Every rank is the
    first slot of its group, so only groups of several suffixes are sorted again. The last ranks are the inverse
    suffix array; a closing -1 stands for the place after the last word.
    """
    n = len(key)
    order = np.argsort(key, kind="stable").astype(np.int32)
    slots = np.arange(n, dtype=np.int32)
    own, after = key[order], np.zeros(n, np.int32)
    rank = np.full(n + 1, -1, np.int32)
    levels: list[np.ndarray] = []
    reach = 1
    while True:
        first = np.ones(len(slots), bool)
        first[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        start = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        rank = rank.copy()
        rank[order[slots]] = start
        levels.append(rank)
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order, levels
        at = order[slots]
        far = at + reach
        own = rank[at]
        after = np.where(far < end[at], rank[np.minimum(far, n)], -1)
        again = np.lexsort((after, own))
        order[slots] = at[again]
        own, after = own[again], after[again]
        reach *= 2


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at different places a and b share."""
    shared = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        shared += (levels[k][a + shared] == levels[k][b + shared]).astype(np.int64) << k
    return shared


def rotations(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often a square at ``at`` can be rotated to the left and still be a square, not before ``begin``."""
    steps = np.zeros(len(at), np.int64)
    for k in reversed(range(len(levels))):
        left = at - steps - (1 << k)
        inside = left >= begin
        left = np.maximum(left, 0)
        steps += (inside & (levels[k][left] == levels[k][np.minimum(left + period, len(levels[k]) - 1)])).astype(np.int64) << k
    return steps


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of every positive value; values[0] is the smallest of all.

    All indices hop over what their candidate has hopped over. The few that need many hops are
    finished from left to right, where every earlier answer is final.
    """
    left = np.maximum(np.arange(len(values)) - 1, 0)
    todo = np.flatnonzero(values[left] >= values)
    todo = todo[values[todo] > 0]  # zeros part the intervals and need no answer
    for _ in range(HOPS):
        if not len(todo):
            return left
        left[todo] = left[left[todo]]
        todo = todo[values[left[todo]] >= values[todo]]
    for i in todo.tolist():
        j = left[i]
        while values[j] >= values[i]:
            j = left[j]
        left[i] = j
    return left


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, first, last): every inner boundary of the intervals with at least ``least`` suffixes.

    Sorted by interval. ``lcp[i]`` belongs to the slots i - 1 and i, ``lcp[0]`` is -1.
    """
    n = len(lcp)
    first = nearest_smaller(lcp)
    last = n - 1 - nearest_smaller(np.concatenate([[-1], lcp[:0:-1]]))
    # reversed position p > 0 holds slot n - p, and its answer p' holds slot n - p', which is one past the last
    last = np.concatenate([[n - 1], last[:0:-1]])
    inner = np.flatnonzero((lcp > 0) & (last - first + 1 >= least))
    inner = inner[np.lexsort((inner, last[inner], first[inner]))]
    return inner, first[inner], last[inner]


def smaller_children(inner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, interval number) of all child ranges but the largest of each interval."""
    new = np.ones(len(inner), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    begin = np.insert(inner, heads, first[heads])  # the first child starts with the interval
    owner = np.insert(group, heads, np.arange(len(heads)))
    end = np.append(begin[1:], 0)
    tail = np.append(owner[1:] != owner[:-1], True)
    end[tail] = last[heads] + 1
    size = end - begin
    opening = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    by_size = np.lexsort((-size, owner))
    small = np.ones(len(begin), bool)
    small[by_size[opening]] = False
    return begin[small], end[small], owner[small]


def periodic_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts that stand one after another; sorted by start, then period.

    ``words`` are word numbers, ``bounds`` the places where a text starts, and the end. A run is at least ``least`` words
    and ``exponent`` (two or more) periods long.
    """
    nothing = np.zeros(0, np.int64)
    if not len(words):
        return nothing, nothing, nothing
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end, begin = bounds[1:][text], bounds[:-1][text]
    order, levels = doubling_ranks(text * (int(words.max()) + 1) + words, end)
    inverse = levels[-1]
    lcp = np.zeros(len(order), np.int64)
    lcp[0] = -1
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    lcp[near] = common_prefix(levels, order[near].astype(np.int64), order[near - 1].astype(np.int64))
    # a run of e periods puts e suffixes into the interval of its last square
    inner, first, last = lcp_intervals(lcp, exponent)
    if not len(inner):
        return nothing, nothing, nothing
    heads = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])))
    from_, to, owner = smaller_children(inner, first, last)
    size = to - from_
    child = np.repeat(np.arange(len(size)), size)
    slot = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + from_[child]
    at = order[slot].astype(np.int64)
    interval = heads[owner[child]]
    depth = lcp[inner[interval]]
    squares, periods = [], []
    for partner, square in ((at + depth, at), (at - depth, at - depth)):
        other = np.where(partner >= 0, inverse[np.clip(partner, 0, len(order))], -1)
        hit = (other >= first[interval]) & (other <= last[interval]) & ((other < from_[child]) | (other >= to[child]))
        squares.append(square[hit])
        periods.append(depth[hit])
    at, period = np.concatenate(squares), np.concatenate(periods)
    stop = at + 2 * period
    start = at - rotations(levels, at, period, begin[at])
    long = stop - start >= np.maximum(least, exponent * period)
    start, stop, period = start[long], stop[long], period[long]
    sort = np.lexsort((period, stop, start))
    start, stop, period = start[sort], stop[sort], period[sort]
    keep = np.ones(len(start), bool)  # a multiple of the period gives the same run
    keep[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[keep], stop[keep], period[keep]
    sort = np.lexsort((period, start))
    return start[sort], stop[sort], period[sort]


def _chunks(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for words in texts:
        if part and size + len(words) > CHUNK_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def collapse(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Per text its runs (start, length, period) and its words without the repeats of any run."""
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    flat = [w for words in texts for w in words]
    numbers = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
    start, stop, period = periodic_runs(numbers.astype(np.int64), bounds, least, exponent)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    texts = list(texts)
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, stop, -1)
    kept = np.cumsum(cover) == 0
    owner = np.searchsorted(bounds, start, "right") - 1
    for d, a, b, p in zip(owner.tolist(), start.tolist(), stop.tolist(), period.tolist()):
        runs[d].append((a - int(bounds[d]), b - a, p))
    for d in set(owner.tolist()):
        texts[d] = [w for w, k in zip(texts[d], kept[bounds[d]:bounds[d + 1]].tolist()) if k]
    return runs, [b" ".join(w) for w in texts]


def find_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of every text as (start, length, period) in words, and the text without repeats.

    Words are parted by ASCII white space. Of a run the first period stays; words in no run's rest are joined by
    one blank. A null or empty text has no runs and an empty collapsed text. Every row is treated whole and
    alone: repeated ids and null ids give a row each, an empty table none; other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            at = 0
            for part in _chunks([t.split() for t in text_bytes(batch.column(1))]):
                runs, rest = collapse(part, least, exponent)
                flat = [r for rs in runs for r in rs]
                columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(shape.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), lists, pa.array(rest, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"]
                )
                at += len(part)

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of most periods, compared exactly; ties keep the first. Null if there is none."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text with a tail that repeats, for one id in ten by crc32: words from a on repeat the p words from a on.

    With h the crc32 of the decimal id and g = h // 10, ids with h % 10 = 0 get a = g % n and
    p = 1 + (n - a) // (3 + g % 8). A null id changes nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        period = F.floor((n - a) / (F.lit(3) + g % 8)).cast("long") + 1

        def word(i: Column, begin: Column, step: Column) -> Column:
            return words[F.when(i < begin, i).otherwise(begin + (i - begin) % step).cast("int")]

        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(let(F.struct(a.alias("a"), period.alias("p")), lambda s: F.transform(places, lambda i: word(i, s["a"], s["p"]))), " ")

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    planted = let(words, lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, planted).otherwise(text)


def run_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    tailed = docs.select(F.col(id_column).alias("doc_id"), repeated_tail(F.col(id_column), F.col(text)).alias("text"))
    found = find_runs(tailed).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
