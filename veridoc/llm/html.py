"""Main text of web pages: a recurrent labeller over the sequence of text blocks.

A page becomes its leaf blocks in order, each with the tags and class words above it. A bidirectional LSTM
reads a hashed tag-path vector, a hashed word vector and a few measures of each block, so a block is
judged with the whole page around it. It is trained in numpy on a bounded sample of pages whose markup
names its parts, and on pages composed from the sample's paragraphs in many layouts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import bounded_batches, bounded_sample

SAMPLE_PAGES = 150
PATH_SLOTS, WORD_SLOTS, MEASURES = 192, 64, 6
INPUT = PATH_SLOTS + WORD_SLOTS + MEASURES
HIDDEN = 12
COMPOSED, STEPS, BATCH = 600, 350, 16

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Skipped elements: without a closing tag the first run to the end of the page, of the others only the tag goes.
TO_THE_END, RAW, NESTED = "script|style", "noscript|iframe|textarea|title", frozenset("template svg canvas select button".split())
EMPTY_IF_CLOSED = NESTED | {*TO_THE_END.split("|"), *RAW.split("|"), "math", "object"}
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# Up to the tag's end, unless a slash that belongs to no unquoted value closes it.
_ATTRIBUTES = r"(?=[\s/>]|\Z)(?:=\s*[^\s\"'>][^\s>]*|\"[^\"]*\"|'[^']*'|[^>\"'/]|/(?!>|\Z))*+"
_PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({TO_THE_END}){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<({RAW}){_ATTRIBUTES}>(?:(?!<\2[\s/>]).)*?</\2\s*>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_OPEN = re.compile(_ATTRIBUTES)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9]")
_CLASS_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]{2,}")


def _skipped(parts: list[re.Match]) -> dict[int, int]:
    """Place in ``parts`` of each element of ``NESTED`` that is closed, with the end of its closing tag."""
    open_: dict[str, list[int]] = {t: [] for t in NESTED}
    ends = {}
    for k, m in enumerate(parts):
        tag = (m[4] or m[7] or "").lower()
        if tag in NESTED:
            if not (m[3] or m[6]):
                if not _closed(m):
                    open_[tag].append(k)
            elif open_[tag]:
                ends[open_[tag].pop()] = m.end()
    return ends


def _closed(m: re.Match) -> bool:
    attributes = m[5] or m[8] or ""
    return attributes.endswith("/") and not _OPEN.fullmatch(attributes)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    words = [tag]
    if "=" in attributes:
        for value in _ATTRIBUTE.findall(attributes):
            words += ["." + w.lower() for w in _CLASS_WORD.findall(value)]
    return tuple(words)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: text between block-level tags, references decoded, white space made one blank."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = [0]
    path: tuple[str, ...] = ()

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            found.append(Block(path, text, linked[0]))
        pieces.clear()
        linked[0] = 0

    def say(raw: str) -> None:
        nonlocal path
        if not raw:
            return
        if all(x.isspace() for x in pieces):
            path = tuple(w for _, names in stack for w in names)
        pieces.append(raw)
        if any(t == "a" for t, _ in stack):
            linked[0] += len(raw)

    at = 0
    parts = list(_PART.finditer(page))
    skipped = _skipped(parts)
    for k, m in enumerate(parts):
        if m.start() < at:  # inside a skipped element
            continue
        say(page[at:m.start()])
        at = skipped.get(k, m.end())
        tag = (m[4] or m[7] or "").lower()
        if not tag or k in skipped or (_closed(m) and tag in EMPTY_IF_CLOSED):
            continue
        closing = bool(m[3] or m[6])
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID_TAGS:
            closes = CLOSES_ITSELF.get(tag)
            for i in range(len(stack) - 1 if closes else -1, -1, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
            stack.append((tag, _names(tag, m[5] or m[8] or "")))
    say(page[at:])
    flush()
    return found


# --- vectors ----------------------------------------------------------------------------------

@lru_cache(maxsize=1 << 16)
def _word_slot(word: str) -> int:
    return crc32(word.encode()) % WORD_SLOTS


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: tag-path and word hashes, then length, link share, digits, stops, depth and place."""
    x = np.zeros((len(page), INPUT), np.float32)
    for i, b in enumerate(page):
        for name in set(b.path):
            x[i, crc32(name.encode()) % PATH_SLOTS] = 1
        for name in b.path[-3:]:
            x[i, crc32(b"leaf " + name.encode()) % PATH_SLOTS] += 0.5
        words = b.text.lower().split()
        slots = np.bincount(list(map(_word_slot, words)), minlength=WORD_SLOTS)
        x[i, PATH_SLOTS:PATH_SLOTS + WORD_SLOTS] = slots / len(words)
        size = len(b.text)
        x[i, -MEASURES:] = (
            np.log1p(size) / 8, min(1.0, b.linked / size), len(_DIGITS.findall(b.text)) / size,
            min(1.0, 20 * sum(map(b.text.count, ".,;")) / size), min(len(b.path), 30) / 30, i / len(page),
        )
    return x


# --- network ----------------------------------------------------------------------------------

def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    b = np.zeros((2, 4 * HIDDEN))
    b[:, HIDDEN:2 * HIDDEN] = 1  # remember at first
    return {
        "x": rng.normal(0, 0.15, (2, INPUT, 4 * HIDDEN)), "u": rng.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)), "b": b,
        "o": rng.normal(0, 0.3, 2 * HIDDEN), "c": np.zeros(1),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward(p: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """(probabilities (time, lanes), states (2, time, lanes, hidden), tape); padding keeps the state."""
    steps, lanes, _ = x.shape
    both, alive = np.stack([x, x[::-1]]), np.stack([real, real[::-1]])[..., None]
    given = both.reshape(2, -1, INPUT) @ p["x"] + p["b"][:, None]
    given = given.reshape(2, steps, lanes, -1)
    h = c = np.zeros((2, lanes, HIDDEN))
    states, tape = np.zeros((2, steps, lanes, HIDDEN)), []
    for t in range(steps):
        g = given[:, t] + h @ p["u"]
        i, f, o = (_sigmoid(g[..., k * HIDDEN:(k + 1) * HIDDEN]) for k in (0, 1, 2))
        n = np.tanh(g[..., 3 * HIDDEN:])
        c_new = f * c + i * n
        out = np.tanh(c_new)
        if keep:
            tape.append((h, c, i, f, o, n, out))
        c = np.where(alive[:, t], c_new, c)
        h = np.where(alive[:, t], o * out, h)
        states[:, t] = h
    joined = np.concatenate([states[0], states[1, ::-1]], axis=2)
    return _sigmoid(joined @ p["o"] + p["c"]), states, tape


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the blocks and its gradients, through time."""
    prob, states, tape = forward(p, x, real, True)
    total = max(real.sum(), 1)
    loss = -(np.log(np.where(y == 1, prob, 1 - prob) + 1e-9) * real).sum() / total
    d = (prob - y) * real / total
    joined = np.concatenate([states[0], states[1, ::-1]], axis=2)
    grads = {"o": np.einsum("tl,tlh->h", d, joined), "c": np.array([d.sum()])}
    d_out = d[..., None] * p["o"]
    d_states = np.stack([d_out[..., :HIDDEN], d_out[::-1, :, HIDDEN:]])
    both, alive = np.stack([x, x[::-1]]), np.stack([real, real[::-1]])[..., None]
    d_given = np.zeros((2, *x.shape[:2], 4 * HIDDEN))
    grads["u"] = np.zeros_like(p["u"])
    dh, dc = np.zeros_like(states[:, 0]), np.zeros_like(states[:, 0])
    for t in range(x.shape[0] - 1, -1, -1):
        h, c, i, f, o, n, out = tape[t]
        live = alive[:, t]
        dh = dh + d_states[:, t]
        dh_t, dc_t = dh * live, dc * live
        dc_t = dc_t + dh_t * o * (1 - out * out)
        g = np.concatenate([dc_t * n * i * (1 - i), dc_t * c * f * (1 - f), dh_t * out * o * (1 - o), dc_t * i * (1 - n * n)], axis=2)
        d_given[:, t] = g
        grads["u"] += h.transpose(0, 2, 1) @ g
        dh = g @ p["u"].transpose(0, 2, 1) + dh * ~live
        dc = dc_t * f + dc * ~live
    flat = d_given.reshape(2, -1, 4 * HIDDEN)
    grads["x"] = both.reshape(2, -1, INPUT).transpose(0, 2, 1) @ flat
    grads["b"] = flat.sum(1)
    return float(loss), grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, real = np.zeros((longest, len(pages), INPUT), np.float32), np.zeros((longest, len(pages)), bool)
    for k, v in enumerate(pages):
        x[:len(v), k], real[:len(v), k] = v, True
    return x, real


# --- training pages ---------------------------------------------------------------------------

MAIN_NAMES = frozenset({"article", "main"})
OTHER_NAMES = frozenset(
    "nav footer header aside form .nav .menu .footer .header .sidebar .comment .comments .ad .ads .advert .advertisement .notice .cookie .banner .related .share".split()
)
_CONTENT = [
    "<article>", "<main>", '<main class="content">', '<div class="content">', '<div id="content">', '<div class="post-content">', '<div class="entry-content">',
    '<div class="article-body">', '<div class="story">', '<section class="article">', '<div class="post">', '<div id="main-text">', '<article class="post">', '<div class="text">',
]
_AROUND = ["", "", '<div class="wrapper">', '<div id="page">', '<div class="container"><div class="row">', '<div class="layout">']
_OTHER = {
    "menu": ["<nav>", '<ul class="menu">', '<div class="navbar">', '<div id="nav">', '<div class="breadcrumb">', '<div role="navigation">'],
    "header": ["<header>", '<div class="header">', '<div id="masthead">', '<div class="top-bar">', '<header class="site-header">'],
    "side": ["<aside>", '<div class="sidebar">', '<div class="related">', '<div class="widget">', '<aside class="recommended">', '<div id="right-column">', '<div class="teaser">'],
    "notice": ['<div class="notice">', '<div class="cookie-banner">', '<div class="alert">', '<div id="consent">', '<p class="notice">', '<div class="newsletter">', '<div role="alert">', '<div class="message">'],
    "advert": ['<div class="ad">', '<div class="advert">', '<div class="sponsored">', '<div class="promo">', '<aside class="ads">', '<div class="banner">', '<section class="advertisement">'],
    "form": ["<form>", '<form class="search">', '<form id="login"><div>', "<form><label>", "<form><fieldset>"],
    "comments": ['<section class="comments">', '<div id="comments">', '<ul class="comment-list">', '<div class="comment">', '<div class="discussion">', '<div class="replies">', '<section id="reader-comments">', '<div class="user-comments">', '<ol class="commentlist">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<footer class="site-footer">'],
}
_SHAPES = ["<p>{}</p>"] * 8 + [
    "<p><b>{}<br></p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}<li>{}</ul>",
    "<ol><li>{}</li><li>{}</li></ol>", "<pre>{}</pre>", "<dl><dt>{}<dd>{}</dl>", "<figure><img src=x><figcaption>{}</figcaption></figure>",
    "<table><tr><th>{}</th><th>{}</th></tr><tr><td>{}</td><td>{}</td></tr></table>", "<table><tbody><tr><td>{}<td>{}</table>",
]
_STOCK = (
    "Home|About us|Contact|Sign in|Register|Search|Privacy policy|Terms of use|Subscribe to our newsletter|Share this|Read more|Related articles|"
    "We use cookies to improve your experience|Accept all|Leave a reply|3 comments|Posted by|Advertisement|Sponsored|All rights reserved|© 2020|Follow us|Tags|Log in|Next|Previous"
).split("|")


def _close(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening)))


def compose(rng: np.random.Generator, paragraphs: list[str]) -> str:
    """A page in a random layout; each text starts with \\x01 where it is main text and \\x02 elsewhere."""
    def pick(xs):
        return xs[int(rng.integers(len(xs)))]

    def words(low: int, high: int) -> str:
        w = pick(paragraphs).split()
        return entities.escape(" ".join(w[: int(rng.integers(low, high))]))

    def other(kind: str) -> str:
        opening = pick(_OTHER[kind])
        n = int(rng.integers(1, 5))
        if kind == "menu":
            body = "<ul>" + "".join(f'<li><a href="#">\x02{pick(_STOCK) if rng.random() < 0.3 else words(1, 4)}</a></li>' for _ in range(n + 2)) + "</ul>"
        elif kind == "comments":
            body = "".join(f'{pick(["<p>", "<div>", "<li>"])}\x02{words(3, 60)}' for _ in range(n))
            body = (f"<h3>\x02{pick(_STOCK)}</h3>" if rng.random() < 0.5 else "") + body
        elif kind == "form":
            body = f"\x02{pick(_STOCK)} <input type=text> {words(1, 3)}"
        else:
            body = "".join(pick(["<p>\x02{}</p>", "<div>\x02{}</div>", "\x02{}", '<a href="#">\x02{}</a>']).format(pick(_STOCK) if rng.random() < 0.3 else words(1, 40)) + "<hr>" for _ in range(n))
        return opening + body + _close(opening)

    content, around = pick(_CONTENT), pick(_AROUND)
    inner = [f"<h1>\x01{words(3, 12)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(int(rng.integers(1, 12))):
        shape = pick(_SHAPES)
        longest = 200 if "<p>" in shape or "<div>" in shape else 20
        inner.append(re.sub(r"\{\}", lambda _: "\x01" + words(2 if longest > 20 else 1, longest), shape))
    if rng.random() < 0.35:
        inner.insert(int(rng.integers(1, len(inner) + 1)), other(pick(["advert", "side", "notice", "form", "comments"])))
    before = [other(k) for k in ("notice", "header", "menu", "menu", "advert") if rng.random() < 0.5]
    after = [other(k) for k in ("comments", "side", "advert", "form", "footer") if rng.random() < 0.5]
    return "<html><body>" + around + "".join(before) + content + "".join(inner) + _close(content) + "".join(after) + _close(around) + "</body></html>"


def named_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page whose markup names its main part, else None."""
    if not any(MAIN_NAMES & set(b.path) for b in page):
        return None
    labels = []
    for b in page:
        at = max(i for i, w in enumerate(b.path) if w in MAIN_NAMES) if MAIN_NAMES & set(b.path) else None
        labels.append(int(at is not None and not OTHER_NAMES & set(b.path[at:])))
    return labels


def train(pages: list[str], seed: int = 0, composed: int = COMPOSED, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Fit by Adam on the given pages where their markup names the main part, and on composed pages."""
    rng = np.random.default_rng(seed)
    examples, paragraphs = [], []
    for page in pages:
        b = blocks(page)
        labels = named_labels(b) if b else None
        if labels:
            examples.append((vectors(b), np.array(labels)))
        paragraphs += [x.text for x in b if x.text.count(" ") >= 2]
    paragraphs = paragraphs or ["The quick brown fox jumps over the lazy dog, and then it rests."]
    for _ in range(composed):
        b = blocks(compose(rng, paragraphs))
        labels = np.array([int("\x01" in x.text) for x in b])
        for x in b:
            x.text = x.text.replace("\x01", "").replace("\x02", "").strip() or "-"
        examples.append((vectors(b), labels))
    p = start(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = [examples[i] for i in rng.integers(len(examples), size=BATCH)]
        x, real = _padded([e[0] for e in chosen])
        y = np.zeros(real.shape)
        for k, (_, labels) in enumerate(chosen):
            y[:len(labels), k] = labels
        _, g = gradients(p, x, y, real)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def main_texts(weights: dict[str, np.ndarray], pages: list[str]) -> list[str]:
    """Main text of each page: its blocks labelled main, joined by line breaks; pages are read side by side by length."""
    parsed = [blocks(p) for p in pages]
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(parsed[i])) if parsed[i]]
    out = [""] * len(pages)
    at = 0
    while at < len(order):
        lanes = max(1, min(64, 4000 // len(parsed[order[min(at + 63, len(order) - 1)]])))
        mine = order[at:at + lanes]
        x, real = _padded([vectors(parsed[i]) for i in mine])
        prob = forward(weights, x, real)[0]
        for k, i in enumerate(mine):
            out[i] = "\n".join(b.text for b, q in zip(parsed[i], prob[:, k]) if q >= 0.5)
        at += lanes
    return out


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; the text is empty where nothing is main text.

    A null page counts as empty. The network learns from at most ``sample_pages`` pages, taken in hash
    order; only they reach the driver. Pages are labelled whole and one by one, so nothing is
    shuffled; repeated ids give a row each, an empty table none, other columns are not looked at.
    """
    bounded_batches(pages.sparkSession)
    shown = pages.filter(F.col(html).isNotNull()).select(F.col(id_column).cast("string").alias("_i"), F.col(html).cast("string").alias("_h"))
    picked = bounded_sample(shown, F.xxhash64("_i", "_h", F.lit(5)), sample_pages)
    weights = train([r[0] for r in picked.select("_h").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(weights, [h or "" for h in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    plain = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
