import numpy as np
import xxhash

from veridoc.llm import near_dedup as nd
from veridoc.llm.common import components


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_code_is_perfect():
    near, fresh = nd.near_codewords()
    assert near.shape == (1 << 16, 17) and near.max() < 1 << 12
    assert fresh[:, 0].all() and fresh.sum(1).max() == 6  # its own codeword and at most five more


def test_keys_meet_for_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.integers(-2**63, 2**63 - 1, 4000, dtype=np.int64)
    y = x.copy().view(np.uint64)
    for i in range(len(x)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    keys_x, keys_y = (set(zip(*(a.tolist() for a in nd.fuzzy_keys(v)))) for v in (x, y.view(np.int64)))
    assert {row for _, row in keys_x & keys_y} == set(range(len(x)))


def test_fingerprint_matches_its_definition(prose):
    for text in ["", " \t\n", "One", "One two three", "A b c d", "ÉCOLE École  x\x0by\x0cz q", prose(300), "a b c d " * 40, " non breaking  a b c d"]:
        assert nd.fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


def test_links_in_small_and_dealt_blocks(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**62))
    fps = {centre}
    while len(fps) < 400:  # a hot group of near copies and strangers
        x = centre
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x if len(fps) % 3 else int(rng.integers(0, 2**63 - 1)))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    masks = {f: f & (1 << 64) - 1 for f in signed}
    expected = closure([(a, b) for a in signed for b in signed if a < b and (masks[a] ^ masks[b]).bit_count() <= 4], signed)
    for block in (16, 1024):
        got = closure([tuple(r) for r in nd.links(classes, 4, block).collect()], signed)
        assert got == expected


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == closure([e for e in edges if e[0] != e[1]], sorted({n for e in edges for n in e}))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark, documents, prose):
    base = prose(400)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in range(0, 400, 9)]
    texts = [base, base, *near, *(prose(50) for _ in range(30)), None, "", "  \n", "one", "ONE", "long " * 30000, "long " * 30000]
    rows = [(1000 - i, t, "en", "s") for i, t in enumerate(texts)] + [(None, base, "en", "s"), (None, "alone without an id here", None, None), (1000, "second text of an id", "en", "s")]
    got = nd.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    prints = [plain_fingerprint(t) for _, t, _, _ in rows]
    n = range(len(rows))
    group = closure([(a, b) for a in n for b in n if a < b and (prints[a] ^ prints[b]).bit_count() <= 4], n)
    least = {}
    for i in n:
        ids = [rows[j][0] for j in n if group[j] == group[i] and rows[j][0] is not None]
        least[i] = min(ids, default=None)
    want = sorted((str(rows[i][0]), prints[i], str(least[i])) for i in n)
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == want


def test_one_of_each_keeps_columns_and_one_row(documents, prose):
    a, b = prose(80), prose(80)
    docs = documents([(5, a, "en", "s"), (3, a, "en", "s"), (3, a, "en", "s"), (9, b, None, None), (None, a, "en", "s"), (None, "only here", "en", "s"), (None, "only here", "en", "s")])
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("3", a), ("9", b), ("None", "only here")])
    assert nd.one_of_each(docs.limit(0)).count() == 0


def test_components_of_the_same_id_each_keep_a_row(documents, prose):
    a, b, c = prose(80), prose(80), prose(80)
    rows = [(3, a, "en", "x"), (3, a, "en", "s"), (3, b, "en", "s"), (4, b, "en", "s"), (None, c, "en", "s"), (None, c, "fr", "s")]
    kept = [sorted((str(r.doc_id), r.text, r.lang, r.source) for r in nd.one_of_each(documents(x)).collect()) for x in (rows, rows[::-1])]
    assert sorted((i, t) for i, t, _, _ in kept[0]) == sorted([("3", a), ("3", b), ("None", c)])
    assert kept[0] == kept[1]
