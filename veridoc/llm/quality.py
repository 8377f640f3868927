"""Quality scores from pairwise preferences (Bradley-Terry), cut at a score quantile."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import bounded_batches, fold, text_bytes

FOLDS, HELD_OUT = 3, 1
SAMPLE_ROWS = 8000
PAIRS_PER_REJECT = 24
STEPS = 500
L2 = 1e-3
SHORT_WORDS, TYPICAL_WORD = 20, 6.5  # as if so many ordinary words were there: a text of few words shows little

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "space": b" ",
    "break": b"\n\r\t",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*+/<=>@[\\]^_`{}~",
    "beyond_ascii": bytes(range(128, 256)),
}
_MEMBER = np.array([[b in members for b in range(256)] for members in _CLASSES.values()], np.float64)
FEATURES = [*_CLASSES, "repeated_word", "repeated_line", "marked_word", "word_length", "line_words"]


def features(text: bytes) -> np.ndarray:
    """Shares of byte classes, of repeated neighbours and of words with marks, and two mean lengths."""
    size, words = len(text), text.split()
    counts = _MEMBER @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(words) + SHORT_WORDS
    lines = [x for x in text.splitlines() if x]
    again = sum(map(eq, words, words[1:])) / n
    lines_again = (len(lines) - len(set(lines))) / (len(lines) + 1)
    marked = min(1.0, counts[5:8].sum() / n)
    word_length = min((size + TYPICAL_WORD * SHORT_WORDS) / n, 40.0) / 40
    line_words = min(n / (len(lines) + 1), 400.0) / 400
    return np.array([*counts / (size + TYPICAL_WORD * SHORT_WORDS), again, lines_again, marked, word_length, line_words])


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(x . weights - cut))), with x a row of ``FEATURES``."""

    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """Fit on feature differences of (preferred, other) pairs; cut at the quantile of the rejected share.

    Each pair adds log(1 + exp(-(s_preferred - s_other))). Without both labels there are no pairs:
    all weights are zero and every score is 0.5, so that nothing is rejected.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(len(FEATURES)), 0.0)
    rng = np.random.default_rng(seed)
    scale = x.std(0) + 1e-6
    pairs = (x[rng.choice(good, (len(bad), PAIRS_PER_REJECT))] - x[bad][:, None]).reshape(-1, x.shape[1]) / scale
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for step in range(1, STEPS + 1):
        lost = 1 / (1 + np.exp(np.clip(pairs @ w, -50, 50)))
        grad = L2 * w - lost @ pairs / len(pairs)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w = w / scale
    ranked = np.sort(x @ w)
    return Model(w, float((ranked[len(bad) - 1] + ranked[len(bad)]) / 2))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold, taken in hash order.

    The sample is the only thing that reaches the driver, as one feature row per document. Rows
    without an id, a text or a label of 0 or 1 teach nothing; texts that share an id are averaged.
    """
    bounded_batches(docs.sparkSession)
    taught = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("_id"), FOLDS) != HELD_OUT))
        .distinct().orderBy(F.xxhash64("_id", F.lit(1)), "_id", "_y").limit(sample_rows)
    )

    @F.arrow_udf("array<double>")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([features(t).tolist() for t in text_bytes(texts)], pa.list_(pa.float64()))

    shown = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).filter("_text is not null")
    joined = shown.join(F.broadcast(taught), "_id").select("_id", "_y", rows("_text").alias("_x"))
    means = [F.avg(F.col("_x")[i]).alias(f"x{i}") for i in range(len(FEATURES))]
    found = joined.groupBy("_id", "_y").agg(*means).orderBy("_id", "_y").toPandas()
    x = found[[f"x{i}" for i in range(len(FEATURES))]].to_numpy(np.float64).reshape(-1, len(FEATURES))
    return fit_pairs(x, found["_y"].to_numpy())


def score(model: Model, text: Column) -> Column:
    """The score of whole texts; a null text counts as empty. Reads nothing but the text."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        return pa.array(model.score(np.stack([features(t) for t in text_bytes(texts)])))

    return run(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; ``predicted`` is 1 from a score of 0.5 on.

    Null texts count as empty, repeated ids are scored row by row, an empty table gives no rows.
    """
    model = fit(docs, labels, sample_rows)
    plain = docs.select(F.col("doc_id").alias("doc_id"), score(model, F.col("text")).alias("score"))
    return plain.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    model = fit(docs, labels, sample_rows)
    return docs.filter(score(model, F.col("text")) >= 0.5)
