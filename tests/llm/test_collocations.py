import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa

import oracle
from veridoc.llm import collocations as C


def plain_counts(rows):
    """Counter of (lang, words) over all pieces, and the number of words."""
    counts, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    return counts, n


def plain_collocations(rows, least, keep):
    counts, n = plain_counts(rows)
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    found = {}
    for (lang, words), a in candidates.items():
        if any(
            other == lang and len(longer) > len(words) and 100 * b >= 80 * a
            and any(longer[i:i + len(words)] == words for i in range(len(longer))) for (other, longer), b in candidates.items()
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((Fraction(2_000_000 * a, left + right).__floor__(), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, items in found.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(items)[:keep], 1)
    )


def some_rows(seed, size=80):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "dé", "E\x00", "ı", "zz-top"]
    rows = []
    for i in range(size):
        text = "".join(rng.choice(words[: rng.randint(2, 8)]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ";"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "de", None, "x\ny"]), "s"))
    rows += [(None, None, "en", None), (1, "", "en", "s"), (1, "...", "fr", "s"), (2, "a b c a b c " * 300, "en", "s"), (3, "a b a b a b", None, "s"), (3, "a b a b a b", None, "s")]
    return rows


def local_counts(rows, parts, least):
    """The counting and merging functions in this process, with the exchange between them as a sort."""
    batch = pa.RecordBatch.from_arrays([pa.array([("und" if r[2] is None else r[2]) for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["lang", "text"])
    runs = [r for b in C._counted(parts)(iter([batch.slice(0, 40), batch.slice(40)])) for r in b.to_pylist()]
    done, passes = [], 0
    while runs:
        passes += 1
        runs.sort(key=lambda r: (r["part"], r["lang"]))
        shape = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("run", pa.binary())])
        found = [r for b in C._merged(least, passes)(iter(pa.Table.from_pylist(runs, shape).to_batches(max_chunksize=3))) for r in b.to_pylist()]
        done += [r for r in found if r["run"] is None]
        runs = [{k: r[k] for k in ("part", "lang", "run")} for r in found if r["run"] is not None]
    return done, passes


def test_bursts_spills_and_finer_parts_keep_all_counts(monkeypatch):
    rows = some_rows(1)
    counts, n = plain_counts(rows)
    want = {(lang, " ".join(words)): c for (lang, words), c in counts.items() if c >= 5}
    for burst, entries, slices, merged in ((4096, 10**6, 10**5, 10**6), (3, 40, 50, 10**6), (10**6, 100, 30, 40)):
        monkeypatch.setattr(C, "BURST", burst)
        monkeypatch.setattr(C, "TRIE_ENTRIES", entries)
        monkeypatch.setattr(C, "SLICE_WORDS", slices)
        monkeypatch.setattr(C, "MERGE_ROWS", merged)
        done, passes = local_counts(rows, 3, 5)
        assert {(r["lang"], r["phrase"]): r["count"] for r in done if r["phrase"] is not None} == want
        totals = Counter()
        for r in done:
            totals[r["lang"]] += r["count"] if r["phrase"] is None else 0
        assert +totals == +n
        assert (passes > 1) == (merged == 40)


def test_full_dictionaries_are_begun_anew(monkeypatch):
    monkeypatch.setattr(C, "SLICE_WORDS", 10)
    rows = [(i, " ".join(f"w{j % 170}" for j in range(i, i + 9)), "en", "s") for i in range(200)]
    begun = []
    monkeypatch.setattr(C.HatTrie, "__init__", lambda self, plain=C.HatTrie.__init__: (begun.append(1), plain(self))[1])
    counts, _ = plain_counts(rows)
    monkeypatch.setattr(C, "WORDS_MOST", 60)
    done, _ = local_counts(rows, 2, 2)
    assert sum(begun) > 1
    assert {r["phrase"]: r["count"] for r in done if r["phrase"] is not None} == {" ".join(w): c for (_, w), c in counts.items() if c >= 2}


def test_runs_survive_encoding():


    words = [b"", b"a", "é".encode()][1:]
    phrases = np.array([[1, 0, 0, 0], [1, 2, 0, 0], [2, 2, 2, 1]])
    for counts in ([1, 2**40, 3], [1, 2, 3]):
        got = C.decode(C.encode(C._objects(words), phrases, np.array(counts)))
        assert got[0] == words and got[1].tolist() == phrases.tolist() and got[2].tolist() == counts


def test_collocations_equal_plain_version(documents):
    for seed, least, keep in ((2, 10, 2000), (3, 5, 7)):
        rows = some_rows(seed)
        got = C.collocations(documents(rows), least=least, keep=keep)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, keep)


def test_collocations_equal_sql(documents):
    rows = [r for r in some_rows(4, 150) if "\x00" not in (r[1] or "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[1:3] for r in rows])
    assert oracle.compare(C.collocations(documents(rows)), con, C.COLLOCATIONS_SQL.replace("{docs}", "documents")) is None


def test_empty_table(documents):
    assert C.collocations(documents([])).collect() == []


def test_products_beyond_64_bits(spark):
    row = spark.sql(f"SELECT CAST(2000000 AS DECIMAL(7, 0)) * {C._long('a')} div ({C._long('l')} + {C._long('r')}) AS score FROM VALUES (9000000000000000001L, 9000000000000000007L, 9000000000000000005L) AS t(a, l, r)")
    assert row.first()[0] == 2_000_000 * 9000000000000000001 // (9000000000000000007 + 9000000000000000005)
