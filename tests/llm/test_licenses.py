import random
import re

import duckdb
import pytest

import oracle
from veridoc.llm import licenses

NOTICE = dict(licenses.NOTICES)["mit"]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    """Places and labels of the base phrases by comparing at every word."""
    found = plain_words(text)
    hits = [(i, label) for label, phrase in licenses.BASE for i in range(len(found)) if found[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return (len(found), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))


def changed(text, rng, share):
    """The text with some words replaced, inserted or dropped."""
    out = []
    for w in text.split():
        kind = rng.random()
        if kind < share / 3:
            continue
        out.append("zzz" if kind < share * 2 / 3 else w)
        if kind > 1 - share / 3:
            out.append("qqq")
    return " ".join(out)


@pytest.fixture(scope="module")
def rows(prose):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice([
                "Licensed under the Apache License, Version 2.0.", "Released UNDER the MIT\nLicense!", "CC BY-NC 4.0", "cc by nc cc by nc",
                "under the mit", "apache license version 20", "GNU General Public License, version 3", "licensed under the GNU General Public License, version 3",
                changed(NOTICE, rng, rng.choice([0.0, 0.05, 0.3])), "of the software " * 30,
            ]))
            parts.append(prose(rng.randint(0, 5)))
        rows.append((i, rng.choice([" ", "\n", ". "]).join(parts), "en", "s"))
    return rows + [
        (100, None, None, None), (101, "", "en", "s"), (102, "cc by", "en", "s"), (None, "cc by nc", "en", "s"), (None, "cc by nc", "en", "s"),
        (103, "éCC BY NC cc\x00by{nc", "fr", "s"), (104, "İ under the mıt license, under the Mit license", "tr", "s"), (104, "other text", "tr", "s"),
        (105, prose(30_000) + " Permission granted. " + NOTICE.upper(), "en", "s"), (106, "Kelvin K BY NC", "en", "s"),
    ]


def test_base_places_equal_plain_search(documents, rows):
    got = licenses.scan(documents(rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *plain_base(t))) for i, t, _, _ in rows)


def test_scan_equals_sql(spark, documents, rows):
    rows = [r for r in rows if "\x00" not in (r[1] or "")]
    docs = documents(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert oracle.compare(licenses.scan(docs), con, licenses.SCAN_SQL.replace("{docs}", "documents")) is None


def test_notices_survive_small_changes_and_long_ones_do_not(documents, prose):
    rng = random.Random(2)
    light, heavy = changed(NOTICE, rng, 0.05), changed(NOTICE, rng, 0.6)
    inserted = " ".join(w if n != 30 else w + " (see the file named above)" for n, w in enumerate(NOTICE.split()))
    texts = [NOTICE, light, heavy, inserted, prose(50) + " " + NOTICE + " " + prose(50), "licensed under the GNU General Public License, version 2", prose(300)]
    got = {r["doc_id"]: r for r in licenses.scan(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["mit", "mit", "", "mit", "mit", "gpl-2", ""]
    assert got[0]["score"] == got[4]["score"] == 1.0 and 0.8 <= got[1]["score"] < 1 and got[2]["score"] == got[6]["score"] == 0
    assert all(got[i]["n_base"] == 0 for i in got)


def test_templates_as_parameter_and_shuffled_index(documents, monkeypatch):
    docs = documents([(1, "one two three four", "en", "s"), (2, "two three", "en", "s")])
    own = [("x", "two three four", False)]
    for bound in (licenses.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(licenses, "BROADCAST_GRAMS", bound)
        assert [tuple(r) for r in licenses.spans(docs, own).select("label", "start", "length", "similarity").collect()] == [("x", 1, 3, 1.0)]
    with pytest.raises(ValueError):
        licenses.spans(docs, [("y", "two words", False)])


def test_empty_table(documents):
    assert licenses.scan(documents([])).collect() == []
