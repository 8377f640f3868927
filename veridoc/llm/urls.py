"""URL filters: host and path rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a probability that
mixes orders 1 to 5, every order falling back on the shorter one. A URL's score is the difference of
its two log-likelihoods over its length; the cut is calibrated on URLs that the counts have not seen.
N-gram counts cover every URL that a rule labels, exactly, in tables that grow with the input. What a
character adds to the score follows from the five characters that end with it, so the models are joined to
the distinct windows of five, and these to the distinct URLs; nothing is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import bounded_batches, staged, text_bytes

ORDERS = 5
BACKOFF = 3.0
BINS, RANGE = 2048, 8.0  # calibration histogram: scores are clipped to -RANGE..RANGE
FOLDS = 5
SCALE = 1 << 32  # scores are summed as integers, so that they don't depend on the order
WINDOW_ROWS = 1 << 17

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From the first :// to the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null where none does; the first listed of equals."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(url: Column) -> Column:
    """The text that the models read: digits count as one character, null as empty."""
    return F.translate(F.coalesce(url, F.lit("")), "123456789", "000000000")


def _windows(url: bytes) -> np.ndarray:
    """The five bytes that end at each byte, as numbers; bytes before the start are 2."""
    x = np.frombuffer(b"\x02" * (ORDERS - 1) + url, np.uint8).astype(np.int64)
    out = np.zeros(len(url), np.int64)
    for i in range(ORDERS):
        out = out << 8 | x[i:i + len(url)]
    return out


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, rejected, accepted) to (key, window, times in the text, rejected, accepted), in batches of bounded size."""
    def out(parts: list[tuple]) -> pa.RecordBatch:
        keys = pa.array([k for k, w, *_ in parts for _ in range(len(w))], pa.binary())
        whole = [np.concatenate([p[i] for p in parts]) for i in (1, 2)]
        labels = [np.repeat([p[i] for p in parts], [len(p[1]) for p in parts]) for i in (3, 4)]
        return pa.RecordBatch.from_arrays([keys, *map(pa.array, whole), *map(pa.array, labels)], ["key", "w", "times", "n0", "n1"])

    parts, held = [], 0
    for batch in batches:
        for key, url, n0, n1 in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            windows, times = np.unique(_windows(url), return_counts=True)
            parts.append((key, windows, times, n0, n1))
            held += len(windows)
            if held >= WINDOW_ROWS:
                yield out(parts)
                parts, held = [], 0
    if parts:
        yield out(parts)


def windows_of(texts: DataFrame) -> DataFrame:
    """(key, w, times, n0, n1) for every different window of the (key, text, n0, n1) rows."""
    return texts.filter("text <> ''").mapInArrow(_window_rows, "key binary, w long, times long, n0 long, n1 long")


def window_counts(windows: DataFrame) -> DataFrame:
    """(w, n0, n1): how often the rejected and the accepted URLs hold each window; 0 where only others hold it."""
    return windows.groupBy("w").agg(F.sum(F.col("times") * F.col("n0")).alias("n0"), F.sum(F.col("times") * F.col("n1")).alias("n1"))


def gram_counts(counts: DataFrame, order: int) -> DataFrame:
    """(w, n0, n1) of the n-grams of an order that ends at most at the windows' own: their last ``order`` bytes."""
    return counts.groupBy(_last(F.col("w"), order).alias("w")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _last(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * n) - 1))


def weights(counts: DataFrame) -> DataFrame:
    """(w, v): what each window adds to the score, in units of 1 / ``SCALE``.

    Every order is joined to the shorter one by the last and by the first characters, so that no key has more
    than 256 rows. An n-gram of nothing but the filling before the start has no count as a context.
    """
    grams = {ORDERS: counts}
    for n in range(ORDERS - 1, 0, -1):
        grams[n] = staged(gram_counts(grams[n + 1], n))
    total = grams[1].agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1"))).first()
    known = None
    for n in range(1, ORDERS + 1):
        if n == 1:
            joined = grams[1].select("*", *(F.lit(float(total[i])).alias(f"c{i}") for i in (0, 1)), *(F.lit(1 / 256).alias(f"q{i}") for i in (0, 1)))
        else:
            shorter = known.select(F.col("w").alias("_end"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            context = grams[n - 1].select(F.col("w").alias("_start"), F.col("n0").alias("c0"), F.col("n1").alias("c1"))
            ended = grams[n].withColumns({"_end": _last(F.col("w"), n - 1), "_start": F.shiftright("w", 8)})
            joined = ended.join(shorter, "_end").join(context, "_start", "left").select(
                "w", "n0", "n1", "q0", "q1", *(F.coalesce(f"c{i}", F.lit(0)).alias(f"c{i}") for i in (0, 1)))
        known = joined.select("w", *(((F.least(f"n{i}", f"c{i}") + BACKOFF * F.col(f"q{i}")) / (F.col(f"c{i}") + BACKOFF)).alias(f"p{i}") for i in (0, 1)))
    return known.select("w", F.round((F.log("p1") - F.log("p0")) * SCALE).cast("long").alias("v"))


def scores(texts: DataFrame) -> DataFrame:
    """(key, score) of (key, text, n0, n1) rows with different keys: log-likelihood of accepted less rejected, over the length.

    ``n0`` and ``n1`` say how often a text counts as rejected and as accepted. An empty text has no row.
    """
    windows = windows_of(texts)
    counts = staged(window_counts(windows))
    parts = windows.select("key", "w", "times").join(weights(counts), "w")
    return parts.groupBy("key").agg((F.sum(F.col("v") * F.col("times")) / SCALE / F.sum("times")).alias("score"))


def count_grams(labelled: DataFrame) -> np.ndarray:
    """The exact counts of a small table of (url, accepted) rows: [label, order, place of the gram in its order]; order 0 has the totals.

    For looking at a model; scoring never gathers it.
    """
    url, ok = (F.col(c) for c in labelled.columns[:2])
    one = labelled.select(shape(url).alias("text"), (1 - ok).cast("long").alias("n0"), ok.cast("long").alias("n1"))
    counts = window_counts(windows_of(one.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text", "n0", "n1")))
    found = [gram_counts(counts, n).orderBy("w").toPandas() for n in range(1, ORDERS + 1)]
    out = np.zeros((2, ORDERS + 1, max(1, *map(len, found))), np.int64)
    for n, f in enumerate(found, 1):
        out[:, n, :len(f)] = f[["n0", "n1"]].to_numpy().T
    out[:, 0, 0] = out[:, 1].sum(1)
    return out


def calibrate(histogram: list[tuple[int, int, int]]) -> float:
    """The cut with the best mean of the two recalls, from (label, bin, count); 0 if a label is missing."""
    counts = np.zeros((2, BINS + 1))
    for label, b, n in histogram:
        counts[label, b] += n
    totals = counts.sum(1)
    if not totals.all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), counts.cumsum(1)], axis=1)
    quality = below[0] / totals[0] + 1 - below[1] / totals[1]
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    return float((best[0] + best[-1]) / 2) * 2 * RANGE / BINS - RANGE


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    ``verdict`` is the rule's, and elsewhere allow where the score reaches the cut. The models learn from the
    URLs that a rule allows or blocks, a fifth of which, by hash, is kept for the cut. A null URL, or one
    without ``://``, has an empty host and path, fits no rule and is scored as written (null: 0). Repeated
    rows count as often as they come; an empty table gives no rows; other columns are not looked at.
    """
    bounded_batches(pages.sparkSession)
    plain = pages.select(F.col(id_column).alias("page_id"), F.col(url).cast("string").alias("_url"))
    parted = plain.withColumn("host", host(F.col("_url"))).withColumn("path", path(F.col("_url")))
    ruled = parted.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "_url", "host", "path", "_r.*")
    text = shape(F.col("_url"))
    held = F.pmod(F.xxhash64("_url"), F.lit(FOLDS)) == 0
    ruled = ruled.select(
        "page_id", "host", "path", "rule", "verdict", text.alias("_text"), F.unhex(F.md5(text.cast("binary"))).alias("_key"),
        F.when(F.col("rule").isNotNull(), F.col("verdict").eqNullSafe("allow").cast("int")).alias("_ok"), held.alias("_held"),
    )
    taught = [F.count_if((F.col("_ok") == i) & ~F.col("_held")).alias(f"n{i}") for i in (0, 1)]
    tried = [F.count_if((F.col("_ok") == i) & F.col("_held")).alias(f"h{i}") for i in (0, 1)]
    texts = staged(ruled.groupBy(F.col("_key").alias("key"), F.col("_text").alias("text")).agg(*taught, *tried))
    scored = staged(scores(texts.select("key", "text", "n0", "n1")))
    bins = F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor((F.coalesce("score", F.lit(0.0)) + RANGE) / (2 * RANGE) * BINS))).cast("int")
    binned = texts.filter("h0 + h1 > 0").join(scored, "key", "left").groupBy(bins.alias("b")).agg(F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).collect()
    cut = calibrate([(label, r["b"], r[f"h{label}"]) for r in binned for label in (0, 1)])
    judged = ruled.join(scored.withColumnRenamed("key", "_key"), "_key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_model = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), "score")
