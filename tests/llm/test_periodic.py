import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from veridoc.llm import periodic


def plain_runs(words, least=6, exponent=4):
    """All runs by comparing the words with themselves at every shift."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, q, e) for (s, e), q in found.items() if e - s >= max(least, exponent * q))


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def plain_row(doc_id, text):
    words = plain_words(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[2] - r[0], r[1]), r[0], r[1]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *best, digest("".join(f"{s},{e - s},{q}\n" for s, q, e in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_those_of_all_shifts(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
            if words and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randint(1, 6)
                words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
            texts.append(words)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        flat = np.array([w for words in texts for w in words], np.int64)
        start, end, period = periodic.periodic_runs(flat, bounds, least, exponent)
        want = sorted((s + o, q, e + o) for o, words in zip(bounds.tolist(), texts) for s, q, e in plain_runs(words, least, exponent))
        assert list(zip(start.tolist(), period.tolist(), end.tolist())) == want


def test_nearest_smaller_hops_over_long_slopes():
    values = np.concatenate([[-1], np.arange(500), [0], np.arange(500, 0, -1), [3] * 50, [0]])
    left = periodic.nearest_smaller(values)
    for i in np.flatnonzero(values > 0).tolist():
        assert left[i] == max(j for j in range(i) if values[j] < values[i])


def test_report_equals_plain_version(documents, prose):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = prose(rng.randint(0, 60)).split()
        at = rng.randint(0, len(words))
        words[at:at] = ["ab", "c"] * rng.randint(0, 5) + ["x"] * rng.randint(0, 9)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), "en", "s"))
    rows += [
        (200, None, None, None), (201, "", "en", "s"), (202, " \x0b\n", "en", "s"), (None, "a b c " * 3, "en", "s"), (204, "a " * 5, "en", "s"),
        (205, "a " * 6, "en", "s"), (206, "a b " * 7, "fr", "s"), (207, prose(1500), "en", "s"), (208, ("u v w " * 500) + "u", "en", "s"),
        (209, "a a a a a a b b b b b b c", "en", "s"), (209, "a a a a a a b b b b b b c", "en", "s"),
    ]
    got = [tuple(r) for r in periodic.run_report(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(i, t) for i, t, _, _ in rows), key=str)


def test_columns_and_empty_table(documents):
    empty = periodic.run_report(documents([]))
    assert empty.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert empty.count() == 0


def test_very_long_texts(documents, prose):
    rows = [(1, prose(150_000), "en", "s"), (3, ("u v w " * 100_000) + "u", "en", "s")]
    found = {r["doc_id"]: r for r in periodic.find_runs(documents(rows)).collect()}
    assert [tuple(r) for r in found[3]["runs"]] == [(0, 300_001, 3)]
    assert found[3]["collapsed"] == "u v w"
    assert found[1]["collapsed"].count(" ") <= 150_000


def test_collapsed_text_keeps_one_period(documents):
    found = periodic.find_runs(documents([(1, "go a b a b a b a b a stop", "en", "s")])).first()
    assert [tuple(r) for r in found["runs"]] == [(1, 9, 2)]
    assert found["collapsed"] == "go a b stop"
