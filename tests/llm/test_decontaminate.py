import re
from collections import Counter

from veridoc.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def bag(w, k):
    return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, items):
    """Best window of every (id, item) by trying all windows."""
    best = {}
    for doc_id, text in set(rows):
        d = words(text)
        for item_id, item in items:
            w = words(item)
            if not w or not d:
                continue
            k = min(5, len(w))
            target = bag(w, k)
            for s in range(max(1, len(d) - len(w) + 1)):
                window = d[s:s + len(w)]
                if len(window) < k:
                    continue
                b = bag(window, k)
                common = sum((target & b).values())
                sim = common / (sum(target.values()) + sum(b.values()) - common)
                if sim >= 0.8:
                    key = (doc_id, item_id)
                    if key not in best or (sim, -s) > (best[key][0], -best[key][1]):
                        best[key] = (sim, s)
    return best


def make(documents, spark, prose):
    passages = [prose(n) for n in (15, 24, 40, 59, 120)] + ["one two", "echo echo echo echo echo echo echo echo echo echo echo", "", None, "..."]
    items = [*enumerate(passages), (0, passages[2])]
    w = passages[3].split()
    texts = [
        prose(100) + ". " + passages[0].upper() + "! " + prose(40), passages[1], prose(10) + " " + passages[2] + " " + passages[3],
        " ".join(w[:30] + ["other"] + w[31:]) + " " + prose(30), " ".join(w[:20] + ["a", "b"] + w[24:]), " ".join(w[3:]), " ".join(w[20:]), " ".join(w[::2]),
        "say one, TWO three", "one", "echo " * 40, prose(3000) + " " + passages[4] + " " + prose(3000), None, "", "\n", prose(200),
        " ".join(p + "***" for p in passages[2].split()),
    ]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, passages[1], "en", "s"), (1, passages[1], "en", "s"), (1, prose(30), "en", "s"), (None, "clean", "en", "s")]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    return rows, items, documents(rows), bench


def test_leaks_against_all_windows(spark, documents, prose):
    rows, items, docs, bench = make(documents, spark, prose)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in dc.leaks(docs, bench).collect()}
    want = {k: (round(s, 9), at) for k, (s, at) in brute([(r[0], r[1]) for r in rows], items).items()}
    assert got == want and len(want) >= 9


def test_clean_drops_leaking_rows_only(spark, documents, prose):
    rows, items, docs, bench = make(documents, spark, prose)
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {(i, t) for i, t in {(r[0], r[1]) for r in rows} if brute([(i, t)], items)}
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(r[0]), str(r[1])) for r in rows if (r[0], r[1]) not in bad)
    assert dc.clean(docs, bench.limit(0)).count() == len(rows)
    assert dc.leaks(docs.limit(0), bench).count() == 0


def test_block_keys_cover_the_radius(spark):
    import random

    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(50)]
    near = []
    for f in fps:
        g = f
        for b in rng.sample(range(64), dc.RADIUS):
            g ^= 1 << b
        near.append(g)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(a), sign(b)) for a, b in zip(fps, near)], "a long, b long")
    both = df.select(dc.block_keys("a", dc.RADIUS // dc.BLOCKS).alias("x"), dc.block_keys("b", 0).alias("y")).collect()
    assert all({tuple(k) for k in r.x} & {tuple(k) for k in r.y} for r in both)


def test_simhash_is_the_majority(spark):
    import random

    rng = random.Random(6)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 37, 500)]
    got = spark.createDataFrame([(r,) for r in rows], "h array<long>").select(dc.simhash("h").alias("f")).collect()
    for r, out in zip(rows, got):
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r) > len(r))
        assert out.f & (1 << 64) - 1 == want


def test_main_path_has_no_python(spark, documents, prose):
    _, _, docs, bench = make(documents, spark, prose)
    plan = dc.leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
