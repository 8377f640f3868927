import random

import numpy as np
import pytest

from veridoc.llm import html, language, tokens, urls


# --- main text --------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:'>'}</style><script>var a='</p><p>no';</script></head><body>"
    "<nav><ul><li><a href='/a>b'>Home</a></li><li><a>More</a></li></ul></nav><!-- <p>hidden</p> --><div class=\"ad\">Buy now</div>"
    "<article><h1>Big\n  title</h1><p>First <b>bold<br>line</b> &lt;x&gt; &#233;&nbsp;&eacute; &am<p>Second paragraph of the text, with words.</p></article>"
    "<footer>&copy; nobody</footer></body></html>"
)


def test_blocks_are_split_and_decoded():
    got = [(b.text, b.path[2] if len(b.path) > 2 else "") for b in html.blocks(PAGE)]
    assert [t for t, _ in got] == [
        "Home", "More", "Buy now", "Big title", "First bold line <x> é é &am", "Second paragraph of the text, with words.", "© nobody",
    ]
    for odd in ("", "plain", "<", "<p", "a < b <3", "<p>" * 3000, "</div>" * 50, "<a href=\"x", "<!-- never closed", "<script>x", "&#0; &#x110000;", "\x00"):
        html.blocks(odd)
    assert html.blocks("a < b")[0].text == "a < b"


def test_only_closed_named_elements_are_skipped():
    texts = lambda page: [b.text for b in html.blocks(page)]
    for name in ("svg", "object", "iframe", "canvas", "select", "button", "title", "textarea", "template", "noscript", "math", "script", "style"):
        for tag in (f"<{name}/>", f"<{name} />", f"<{name} a='x>y' b/>", f'<{name.upper()} a="/"/>'):
            assert texts(f"<p>a</p>{tag}<p>rest</p>") == ["a", "rest"]
        if name not in ("script", "style"):
            assert texts(f"<p>a</p><{name} x=1><p>rest</p>") == ["a", "rest"]
        else:
            assert texts(f"<p>a</p><{name} x=1><p>rest</p>") == ["a"]
        if name not in ("math", "object"):
            assert texts(f"<p>a</p><{name} x='>'>no</{name} ><p>rest</p>") == ["a", "rest"]
    for name in ("svg-icon", "title-bar", "object-view", "script-box", "styled", "button-row", "selection"):
        assert texts(f'<p>a</p><{name} n="x">in</{name}><p>rest</p>') == ["a", "in", "rest"]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p><object data=u>told</object><p>rest</p>") == ["a x=1 b", "told", "rest"]
    assert texts("<p>a</p><button>go <p>kept</p><button>no</button><p>rest</p>") == ["a", "go", "kept", "rest"]
    assert texts("<p>a</p><svg><svg>no</svg><text>no</text></svg><p>rest</p>") == ["a", "rest"]
    assert texts("<title>a <!-- b <script> c</title><p>rest</p>") == ["rest"]
    assert texts("<title>a<p>b</p><title>no</title><p>rest</p>") == ["a", "b", "rest"]
    assert texts("<p>a</p><iframe src=http://x.y/>no</iframe><p>rest</p>") == ["a", "rest"]


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    p, x = html.start(1), rng.normal(size=(5, 3, html.INPUT))
    real, y = np.ones((5, 3), bool), rng.integers(0, 2, (5, 3))
    real[3:, 1] = False
    loss, grads = html.gradients(p, x, y, real)
    for k in p:
        for _ in range(3):
            at = tuple(int(rng.integers(n)) for n in p[k].shape)
            q = {n: a.copy() for n, a in p.items()}
            q[k][at] += 1e-5
            assert (html.gradients(q, x, y, real)[0] - loss) / 1e-5 == pytest.approx(grads[k][at], abs=1e-5)


def test_unseen_layouts(prose):
    paragraphs = [prose(60) + "." for _ in range(60)]
    weights = html.train([PAGE], composed=400, steps=250)
    rng = np.random.default_rng(77)
    right = total = 0
    for _ in range(120):
        page = html.compose(rng, paragraphs)
        found = html.blocks(page)
        want = [b.text for b in found if "\x01" in b.text]
        for b in found:
            b.text = b.text.strip("\x01\x02 ") or "-"
        x, real = html._padded([html.vectors(found)])
        kept = html.forward(weights, x, real)[0][:, 0] >= 0.5
        right += sum(k == ("\x01" + b.text in want or "\x01 " + b.text in want) for k, b in zip(kept, found))
        total += len(found)
    assert right / total > 0.96


def test_extract_rows(spark, prose):
    body = [prose(40) + "." for _ in range(3)]
    page = "<html><body><nav><a>Menu</a></nav><article><h1>Head line</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</article><footer>foot</footer></body></html>"
    rows = [(1, "u", page, "c"), (1, "u", page, "c"), (None, None, None, None), (2, "v", "", "c"), (3, None, "<p></p>", "c"), (4, "w", page.replace(body[0], body[0] * 300), "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html.extract(pages).collect()
    assert len(out) == len(rows)
    by = {(r.page_id, r.url): r for r in out}
    assert by[1, "u"].text == "\n".join(["Head line", *body]) and by[4, "w"].text == "\n".join(["Head line", body[0] * 300, *body[1:]])
    assert all(by[k].text == "" for k in ((None, None), (2, "v"), (3, None)))
    assert all(r.n_chars == len(r.text) for r in out)
    assert html.extract(pages.limit(0)).count() == 0


# --- language ---------------------------------------------------------------------------------

def test_gru_gradients_and_reader():
    rng = np.random.default_rng(0)
    p = language._start(3, 1)
    x, y = rng.integers(97, 110, (7, 4)), np.array([0, 1, 2, 1])
    x[5:, 1] = 256
    loss, grads = language.loss_and_gradients(p, x, y)
    for k in p:
        at = (1, int(x[2, 0]), 3) if k == "x" else tuple(int(rng.integers(n)) for n in p[k].shape)
        q = {n: a.copy() for n, a in p.items()}
        q[k][at] += 1e-5
        assert (language.loss_and_gradients(q, x, y)[0] - loss) / 1e-5 == pytest.approx(grads[k][at], abs=1e-5)
    states, _ = language._forward(p, np.stack([x, x[::-1]]))
    assert np.allclose(states, language.Reader(p).states(x), atol=1e-5)


def test_windows_cover_whole_texts():
    p = {k: a.astype(np.float32) for k, a in language._start(2, 3).items()}
    net = language.Network(["a", "b"], p)
    text = b"abcdefgh " * 200
    parts = [text[i:i + language.WINDOW] for i in range(0, len(text), language.WINDOW)]
    whole = net.documents([text])[0]
    pooled = sum(net.documents([w])[0] * len(w) for w in parts) / len(text)
    assert np.allclose(whole, pooled, atol=1e-5) and whole.sum() == pytest.approx(1, abs=1e-4)
    assert net.documents([b"", text])[0].sum() == 0


def test_identify(spark, documents):
    rng = random.Random(0)
    def say(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40))

    rows = [(i, say("aeioulmn" if i % 2 else "krtszpéü"), "xx" if i % 2 else "yy", "s") for i in range(200)]
    rows += [(None, None, None, None), (300, "", "xx", "s"), (301, "123 !!", "xx", "s"), (302, say("aeioulmn"), None, "s"), (303, say("krtszpéü") * 200, "yy", "s"), (5, say("aeioulmn"), "xx", "s")]
    out = language.identify(documents(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
    pred = {r.doc_id: r.lang_pred for r in out}
    assert pred[None] == pred[300] == pred[301] == "und" and pred[302] == "xx" and pred[303] == "yy"
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert len(held) > 20 and np.mean([r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in held]) > 0.97
    assert language.identify(documents(rows).limit(0)).count() == 0


# --- urls -------------------------------------------------------------------------------------

def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))


URLS = [
    None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://a.b.net/es/", "http://net/es/x", "http://botnet/es/x", "http://x.com", "http://x.com/",
    "http://x.com?q=/en/", "http://É.example.com/EN/", "a://b://c.com/d", "http://www.example.com/en/", "http://q.www.example.com/en/z", "http://x.org/é?#", "http://x.com\n/en", "x" * 70000,
    "http://m.example.com/en/" + "y" * 70000,
]


def test_rules_follow_their_definition(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    for r in urls.judge(pages).collect():
        host, path, rule, verdict = plain_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))
    assert urls.judge(pages.limit(0)).count() == 0


def test_model_counts_all_and_separates(spark):
    rng = random.Random(1)
    good, bad = (lambda: f"http://{rng.choice('abc')}.lib.com/paper/{rng.randint(1, 999)}"), (lambda: f"http://{rng.choice('xyz')}.win.net/es/bonus{rng.randint(1, 999)}")
    rows = [(i, good() if i % 2 else bad()) for i in range(600)]
    rows += [(1000 + i, good().replace(".com", ".org") if i % 2 else bad().replace(".net", ".org")) for i in range(60)]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = [out[1000 + i].verdict == ("allow" if i % 2 else "block") for i in range(60)]
    assert np.mean(right) > 0.95
    counts = urls.count_grams(spark.createDataFrame([(u, i % 2) for i, (_, u) in enumerate(rows)], "url string, ok int").repartition(3))
    assert counts[:, 0, 0].sum() == sum(len(u) for _, u in rows)
    assert (counts[:, 1:].sum(2) == counts[:, :1, 0]).all()


def plain_score(url, models):
    """Both models by dictionaries of the n-grams' text."""
    x = b"\x02" * urls.ORDERS + bytes(48 if 48 <= c <= 57 else c for c in (url or "").encode())
    logs = []
    for c in models:
        at = []
        for end in range(urls.ORDERS + 1, len(x) + 1):
            p = 1 / 256
            for n in range(1, urls.ORDERS + 1):
                context = c[x[end - n:end - 1]] if n > 1 else c[b""]
                p = (min(c[x[end - n:end]], context) + urls.BACKOFF * p) / (context + urls.BACKOFF)
            at.append(np.log(p))
        logs.append(sum(at))
    return float(logs[1] - logs[0]) / max(1, len(x) - urls.ORDERS)


def test_scores_are_exact_with_many_n_grams(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(6)
    many = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_.~éü"
    made = [f"http://{rng.choice('abc')}.{rng.choice(['x.com', 'y.net', 'z.org'])}/es/{''.join(rng.choice(many) for _ in range(60))}{rng.randint(1, 99)}" for _ in range(3000)]
    made += [None, "", "a", "\x02\x02a", made[0], made[1], made[1]]
    rows = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    taught = {r.page_id for r in rows.filter(F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)) != 0).collect()}
    models = (Counter(), Counter())
    for i, u in enumerate(made):
        verdict = plain_rule(u)[3]
        if verdict and i in taught:
            x = b"\x02" * urls.ORDERS + bytes(48 if 48 <= c <= 57 else c for c in u.encode())
            for end in range(urls.ORDERS + 1, len(x) + 1):
                models[verdict == "allow"].update(x[end - n:end] for n in range(urls.ORDERS + 1))
    assert len({g for c in models for g in c if len(g) == 5}) > 1 << 16
    out = {r.page_id: r.score for r in urls.judge(rows).collect()}
    assert len(out) == len(made)
    for i, u in enumerate(made[:300] + made[3000:]):
        k = i if i < 300 else i + 2700
        assert out[k] == pytest.approx(plain_score(u, models), abs=1e-8)


def test_calibration():
    assert urls.calibrate([(0, 10, 5), (1, 2000, 5)]) == pytest.approx((10 + 1 + 2000) / 2 * 2 * urls.RANGE / urls.BINS - urls.RANGE, abs=0.02)
    assert urls.calibrate([(1, 5, 5)]) == 0.0


# --- token counts -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pieces():
    return tokens.load_pieces(tokens.default_vocabulary())


def plain_tokens(word, pieces, byte):
    text = tokens.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * byte, best[end - 1][1] - size)]
        options += [(best[s][0] + pieces[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_trie_equals_word_by_word(pieces, prose):
    trie = tokens.Trie(*pieces)
    for w in {*prose(300).split(), "international", "internationally", "日本語", "𝔘x", "▁", "x" * 60, "a"}:
        assert trie.tokens(w) == plain_tokens(w, *pieces)


def test_token_rows(documents, pieces, prose):
    rows = [(1, prose(30), "en", "s"), (1, prose(5), "en", "s"), (None, None, None, None), (2, "", "en", "s"), (3, " \n ", "en", "s"), (4, "word " * 100000, "en", "s")]
    out = sorted(((str(r.doc_id), r.n_words, r.n_tokens) for r in tokens.token_counts(documents(rows)).collect()))
    assert out == sorted((str(i), len((t or "").split()), sum(plain_tokens(w, *pieces) for w in t.split()) if t and i != 4 else (plain_tokens("word", *pieces) * 100000 if i == 4 else 0)) for i, t, _, _ in rows)
    assert tokens.token_counts(documents(rows).limit(0)).count() == 0
