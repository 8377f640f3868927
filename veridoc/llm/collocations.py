"""Phrase collocations: n-grams counted in HAT-tries, then scored by their weakest cut.

Every task counts windows of ``LONGEST`` words in one trie per language. The trie is shallow: the first word leads to a hash
container of the words after it, and a container that grows too large bursts into one container for each
second word. When the tries of a task hold too many entries, whole subtrees, the largest first, are taken out and
written as sorted runs: the windows with their counts, dealt by their first three words, and the totals of shorter
prefixes, dealt by these. The runs of a prefix partition are merged by sorting, equal phrases add up, and those seen often
enough stay. A frequent prefix of one or two words is one entry of a run, whatever it leads to. A partition that
turns out too large for one task is dealt again into finer ones, with the totals of all prefixes, so no key is hot.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import let
from veridoc.llm.common import bounded_batches, staged, text_bytes

# The contract's values.
LONGEST = 4
LEAST = 30
KEEP = 2000
CONTAINED = 80  # per cent of its occurrences inside a longer candidate that drop a phrase
NO_LANGUAGE = "und"

# The method's own values: bounds of memory.
SLICE_WORDS = 200_000  # words added between two looks at the size of the tries
BURST = 1 << 16  # entries of a container
TRIE_ENTRIES = 1_200_000  # entries of a task
ID_BITS = 21  # word numbers in a container's key; a dictionary that fills them is spilled and begun anew
PART_BYTES = 8 << 20  # text per merge partition
PARTS_MOST = 1 << 14
MERGE_ROWS = 4_000_000  # phrases of a partition held at once
FINER = 64  # parts that an overfull one is dealt into

_ID = WORDS_MOST = (1 << ID_BITS) - 1
SHORT = 3  # prefixes shorter than this are totals of their own; longer ones follow from the windows of a part
END = b"."  # stands for every separator, after lower-casing
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PREPARE = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + END * len(_SEPARATORS))


class _Numbers(dict):
    """Words numbered from 1 in the order they come; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Node(dict):
    """A burst container: second word -> container."""

    def __missing__(self, second: int) -> dict[int, int]:
        self[second] = container = {}
        return container


class HatTrie:
    """Counts of the windows of one language: first word -> container of the packed words after it."""

    def __init__(self) -> None:
        self.numbers = _Numbers({END: 0})
        self.tops: list[dict] = [{}]

    def add(self, numbers: list[int]) -> None:
        """Count the windows at every word; a 0 stands after every piece."""
        self.tops += [{} for _ in range(len(self.numbers) - len(self.tops))]
        at = np.array([*numbers, 0, 0, 0], np.int64)
        key, on = np.zeros(len(numbers), np.int64), np.ones(len(numbers), bool)
        for k in range(1, LONGEST):
            nearby = at[k:len(numbers) + k]
            on &= nearby > 0
            key = key << ID_BITS | np.where(on, nearby, 0)
        words = at[:len(numbers)] > 0
        tops, shift = self.tops, ID_BITS * (LONGEST - 2)
        for first, rest in zip(at[:len(numbers)][words].tolist(), key[words].tolist()):
            container = tops[first]
            if container.__class__ is _Node:
                container = container[rest >> shift]
            container[rest] = container.get(rest, 0) + 1
        # a container that gained next to nothing is looked at when it gains more
        for first in np.flatnonzero(np.bincount(at[:len(numbers)][words]) > BURST >> 10).tolist():
            container = tops[first]
            if len(container) > BURST and container.__class__ is dict:
                tops[first] = node = _Node()
                for rest, count in container.items():
                    node[rest >> shift][rest] = count

    def sizes(self) -> np.ndarray:
        return np.array([sum(map(len, t.values())) if t.__class__ is _Node else len(t) for t in self.tops], np.int64)

    def take(self, firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees: (windows of word numbers, counts)."""
        containers: list[dict[int, int]] = []
        owner: list[int] = []
        for first in firsts:
            top, self.tops[first] = self.tops[first], {}
            found = list(top.values()) if top.__class__ is _Node else [top]
            containers += found
            owner += [first] * len(found)
        sizes = np.fromiter(map(len, containers), np.int64, len(containers))
        key = np.fromiter(chain.from_iterable(containers), np.int64, int(sizes.sum()))
        counts = np.fromiter(chain.from_iterable(map(dict.values, containers)), np.int64, len(key))
        rest = [key >> ID_BITS * k & _ID for k in reversed(range(LONGEST - 1))]
        return np.stack([np.repeat(np.array(owner, np.int64), sizes), *rest], 1), counts


def _packed(phrases: np.ndarray) -> np.ndarray:
    """Each phrase as one or two numbers in the same order."""
    bits = max(1, int(phrases.max(initial=0)).bit_length())
    per = LONGEST if bits * LONGEST <= 63 else LONGEST // 2
    columns = [phrases[:, k].astype(np.int64) for k in range(LONGEST)]
    packed = []
    for at in range(0, LONGEST, per):
        number = columns[at]
        for column in columns[at + 1:at + per]:
            number = number << bits | column
        packed.append(number)
    return np.stack(packed)


def _in_order(packed: np.ndarray) -> np.ndarray:
    return np.argsort(packed[0], kind="stable") if len(packed) == 1 else np.lexsort(packed[::-1])


def prefixes(windows: np.ndarray, counts: np.ndarray, depths: tuple[int, ...] = tuple(range(1, LONGEST + 1))) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes, of the given lengths, of sorted windows, filled up with 0, with their counts."""
    rows, sums = [], []
    new = np.zeros(len(windows), bool)
    new[:1] = True
    for depth in range(1, LONGEST + 1):
        new[1:] |= windows[1:, depth - 1] != windows[:-1, depth - 1]
        if depth not in depths:
            continue
        start = np.flatnonzero(new)
        total = np.add.reduceat(counts, start) if len(start) else counts
        whole = windows[start, depth - 1] > 0
        row = np.zeros((int(whole.sum()), LONGEST), windows.dtype)
        row[:, :depth] = windows[start[whole], :depth]
        rows.append(row)
        sums.append(total[whole])
    return np.concatenate(rows), np.concatenate(sums)


def encode(words: np.ndarray, phrases: np.ndarray, counts: np.ndarray) -> bytes:
    """A run: its own sorted dictionary, the phrases as word numbers, column by column, and their counts."""
    present = np.zeros(len(words) + 1, bool)
    present[phrases] = True
    present[0] = False
    used = np.flatnonzero(present)
    local = np.cumsum(present)[phrases] * (phrases > 0)
    dictionary = b"\n".join(words[used - 1].tolist())
    wide, long = len(used) > 0xFFFF, int(counts.max()) > 0xFF
    body = [
        struct.pack("<qq??", len(dictionary), len(counts), wide, long), dictionary,
        local.T.astype(np.int32 if wide else np.uint16).tobytes(), counts.astype(np.int64 if long else np.uint8).tobytes(),
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def decode(run: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(run)
    size, rows, wide, long = struct.unpack_from("<qq??", body)
    at = struct.calcsize("<qq??")
    words = body[at:at + size].split(b"\n")
    columns = np.frombuffer(body, np.int32 if wide else np.uint16, LONGEST * rows, at + size)
    counts = np.frombuffer(body, np.int64 if long else np.uint8, rows, at + size + columns.nbytes)
    return words, columns.reshape(LONGEST, rows).T, counts.astype(np.int64)


def part_of(words: np.ndarray, phrases: np.ndarray, depth: int, parts: int, seed: int) -> np.ndarray:
    """The part of each phrase, by its first ``depth`` words alone."""
    hashes = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words.tolist())], np.uint64)
    mixed = np.zeros(len(phrases), np.uint64)
    for column in phrases.T[:depth]:
        mixed = (mixed ^ hashes[column]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(parts)).astype(np.int64)


def _runs(words: np.ndarray, phrases: np.ndarray, counts: np.ndarray, depth: int, parts: int, seed: int) -> Iterator[tuple[int, bytes]]:
    """(part, run) of sorted phrases, which stay sorted in every part."""
    part = part_of(words, phrases, depth, parts, seed)
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        rows = order[lo:hi]
        yield int(part[rows[0]]), encode(words, phrases[rows], counts[rows])


def _objects(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = words
    return out


def _spill(trie: HatTrie, firsts: list[int], parts: int) -> Iterator[tuple[int, bytes]]:
    windows, counts = trie.take(firsts)
    present = np.zeros(len(trie.numbers), bool)
    present[windows] = True
    used = np.flatnonzero(present[1:]) + 1
    names = _objects(list(trie.numbers))[used]
    order = np.argsort(names, kind="stable")
    rank = np.zeros(len(trie.numbers), np.int32)
    rank[used[order]] = np.arange(1, len(used) + 1)
    windows = rank[windows]
    sort = _in_order(_packed(windows))
    windows, counts = windows[sort], counts[sort]
    short, sums = prefixes(windows, counts, tuple(range(1, SHORT)))
    long = windows[:, SHORT - 1] > 0
    yield from _runs(names[order], np.concatenate([windows[long], short]), np.concatenate([counts[long], sums]), SHORT, parts, 0)


def _counted(parts: int):
    """Count the windows of a task's texts and hand on runs."""
    def batch_of(lang: str, runs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for part, run in runs:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([lang], pa.string()), pa.array([run], pa.binary())], ["part", "lang", "run"])

    def shrink(tries: dict[str, HatTrie], room: int) -> Iterator[pa.RecordBatch]:
        """Spill the largest subtrees until no more than ``room`` entries are left."""
        sizes = {lang: t.sizes() for lang, t in tries.items()}
        held = sum(int(s.sum()) for s in sizes.values())
        if held <= room:
            return
        every = np.sort(np.concatenate(list(sizes.values())))[::-1]
        least = every[min(int(np.searchsorted(np.cumsum(every), held - room // 4)), len(every) - 1)]
        for lang, s in sizes.items():
            firsts = np.flatnonzero((s >= max(least, 1))).tolist()
            if firsts:
                yield from batch_of(lang, _spill(tries[lang], firsts, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        waiting: dict[str, list[int]] = {}
        size = entries = 0  # entries: at most so many are held

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal entries
            for lang, numbers in waiting.items():
                tries[lang].add(numbers)
                entries += len(numbers)
            waiting.clear()
            if entries > TRIE_ENTRIES:
                yield from shrink(tries, TRIE_ENTRIES)
                entries = sum(int(t.sizes().sum()) for t in tries.values())
            for lang in [name for name, t in tries.items() if len(t.numbers) + 2 * SLICE_WORDS > WORDS_MOST]:
                yield from shrink({lang: tries[lang]}, 0)
                del tries[lang]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if lang not in tries:
                    tries[lang] = HatTrie()
                trie = tries[lang]
                held = waiting.setdefault(lang, [])
                before = len(held)
                held.extend(map(trie.numbers.__getitem__, text.translate(_PREPARE).replace(END, b" . ").split()))
                held.append(0)
                size += len(held) - before
                if size >= SLICE_WORDS:
                    size = 0
                    yield from flush()
        yield from flush()
        yield from shrink(tries, 0)

    return run


def merge(runs: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """One run of several: equal phrases add up."""
    words = list(dict.fromkeys(chain.from_iterable(part for part, _, _ in runs)))
    number = dict(zip(words, range(1, len(words) + 1)))
    phrases = np.concatenate([np.array([0, *map(number.__getitem__, part)], np.int32)[rows] for part, rows, _ in runs])
    counts = np.concatenate([c for _, _, c in runs])
    packed = _packed(phrases)
    order = _in_order(packed)
    packed = packed[:, order]
    new = np.ones(len(phrases), bool)
    new[1:] = (packed[:, 1:] != packed[:, :-1]).any(0)
    start = np.flatnonzero(new)
    return words, phrases[order[start]], np.add.reduceat(counts[order], start) if len(start) else counts


def all_prefixes(phrases: np.ndarray, counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged phrases of a part with the totals of every prefix; those of finer parts hold them already."""
    if level > 1:
        return phrases, counts
    short = phrases[:, SHORT - 1] == 0
    long, sums = prefixes(phrases[~short], counts[~short], tuple(range(SHORT, LONGEST + 1)))
    return np.concatenate([phrases[short], long]), np.concatenate([counts[short], sums])


def _merged(least: int, level: int):
    """Merge the runs of each part: frequent phrases, the number of words, or runs of finer parts."""
    shape = [("part", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("count", pa.int64()), ("run", pa.binary())]

    def rows(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, shape)], [n for n, _ in shape])

    def finer(part: int, lang: str, run: tuple[list[bytes], np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, phrases, counts = run
        for sub, data in _runs(_objects(words), *all_prefixes(phrases, counts, level), LONGEST, FINER, level):
            yield rows([[part * FINER + sub], [lang], [None], [None], [None], [data]])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, bytes]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, lang), group in groupby(stream(batches), lambda x: x[:2]):
            held: list[tuple[list[bytes], np.ndarray, np.ndarray]] = []
            size, overfull = 0, False
            for _, _, data in group:
                held.append(decode(data))
                size += len(held[-1][2])
                if size > MERGE_ROWS:
                    held = [merge(held)]
                    size = len(held[0][2])
                    if size > MERGE_ROWS // 2:
                        overfull = True
                        yield from finer(part, lang, held[0])
                        held, size = [], 0
            if overfull:
                if held:
                    yield from finer(part, lang, merge(held))
                continue
            words, phrases, counts = merge(held)
            phrases, counts = all_prefixes(phrases, counts, level)
            total = int(counts[phrases[:, 1] == 0].sum())
            often = np.flatnonzero(counts >= least)
            sizes = (phrases[often] > 0).sum(1).tolist()
            texts = [b" ".join(words[i - 1] for i in p[:k]).decode() for p, k in zip(phrases[often].tolist(), sizes)]
            yield rows([[part] * (len(often) + 1), [lang] * (len(often) + 1), [None, *texts], [0, *sizes], [total, *counts[often].tolist()], [None] * (len(often) + 1)])

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, count): phrases of 1 to ``LONGEST`` words that occur ``least`` times; the phrase null counts all words.

    Texts are lower-cased (A-Z), pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs, and occurrences may overlap.
    Null texts are empty and a null language is ``und``. Counts are exact at any size; the result is staged.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).cast("string").alias("text"))
    weight = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(PARTS_MOST, 1 + weight // PART_BYTES)
    runs = plain.mapInArrow(_counted(parts), "part long, lang string, run binary")
    shape = "part long, lang string, phrase string, size int, count long, run binary"
    finished, level = None, 0
    while True:
        level += 1
        dealt = runs.repartition(parts, "part").sortWithinPartitions("part", "lang")
        found = staged(dealt.mapInArrow(_merged(least, level), shape))
        ready = found.filter("run IS NULL").select("lang", "phrase", "size", "count")
        finished = ready if finished is None else finished.unionByName(ready)
        runs = found.filter("run IS NOT NULL").select("part", "lang", "run")
        if runs.isEmpty():
            return finished


def _long(value: str) -> str:
    return f"CAST({value} AS DECIMAL(20, 0))"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, keep: int = KEEP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``keep`` phrases of each language.

    A phrase of 2 to ``LONGEST`` words with at least ``least`` occurrences a is cut after each of its words into parts of l and r
    occurrences; its score is the least of floor(2000000 a / (l + r)), ties to the first cut. A phrase inside a longer
    candidate with ``CONTAINED`` per cent of its occurrences is dropped. Ranks follow score and a, both falling, then the
    phrase by its UTF-8 bytes. n is the number of words. Null texts are empty, a null language is ``und``; repeated rows count
    again, ids and other columns are not looked at, and languages without such phrases, like empty tables, give no rows.
    """
    found = phrase_counts(docs, text, lang, least)
    often = found.filter("phrase IS NOT NULL")
    totals = found.filter("phrase IS NULL").groupBy("lang").agg(F.sum("count").cast("long").alias("n"))
    candidates = often.filter("size > 1").select("lang", "phrase", "size", F.col("count").alias("a"))
    left, right = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"_left": left, "_right": right})
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(often.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    ratio = F.expr(f"CAST(2000000 AS DECIMAL(7, 0)) * {_long('a')} div ({_long('l')} + {_long('r')})")
    weakest = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(ratio.alias("score"), "k", "l", "r")).alias("cut"))

    def inside(words: Column) -> Column:
        """All shorter phrases of two or more words."""
        spans = [(size, at) for size in range(2, LONGEST) for at in range(LONGEST - size + 1)]
        parts = [F.when(F.size(words) >= F.lit(at + size), F.array_join(F.slice(words, at + 1, size), " ")) for size, at in spans]
        return F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull()))

    longer = candidates.filter("size > 2").select("lang", "size", "a", F.explode(let(F.split("phrase", " "), inside)).alias("_part"))
    covered = longer.filter(F.size(F.split("_part", " ")) < F.col("size")).groupBy("lang", F.col("_part").alias("phrase")).agg(F.max("a").alias("_over"))
    kept = weakest.join(covered, ["lang", "phrase"], "left").filter(f"_over IS NULL OR {_long('_over')} * 100 < {_long('a')} * {CONTAINED}")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of ``collocations`` with the contract's values; ``{docs}`` is the table.
COLLOCATIONS_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM {{docs}}),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (
  SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS c
  FROM g, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND c >= {LEAST}),
cut AS (
  SELECT cand.lang, cand.phrase, a, k, x.c AS l, y.c AS r, ((2000000::HUGEINT * a) // (x.c::HUGEINT + y.c))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) cand
  JOIN f x ON x.lang = cand.lang AND x.phrase = array_to_string(cand.w[1:k], ' ')
  JOIN f y ON y.lang = cand.lang AND y.phrase = array_to_string(cand.w[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (
  SELECT lang, size, a, w, unnest(range(2, size)) AS m FROM cand),
inner_ AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM part)),
covered AS (SELECT lang, phrase, max(a) AS over_ FROM inner_ GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN covered USING (lang, phrase) WHERE over_ IS NULL OR 100::HUGEINT * over_ < {CONTAINED}::HUGEINT * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {KEEP}
"""
