"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read windows of bytes in either direction; every position gets a probability
per language from both states, and a document's are the means over all its positions. The network
is trained by backpropagation through time on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import bounded_batches, bounded_sample, fold, text_bytes

FOLDS, HELD_OUT = 5, 0
HIDDEN = 8
WINDOW = 256  # bytes read as one sequence; a longer text is several
LANES = 512  # windows read side by side
SAMPLE_ROWS = 2000
TRAIN_WINDOW, WINDOWS_A_TEXT, STEPS, BATCH = 64, 4, 400, 128
UNKNOWN = "und"


def _start(classes: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "x": rng.normal(0, 0.3, (2, 257, 3 * HIDDEN)), "u": rng.normal(0, 0.5 / np.sqrt(HIDDEN), (2, HIDDEN, 3 * HIDDEN)),
        "o": rng.normal(0, 0.3, (2 * HIDDEN, classes)), "b": np.zeros(classes),
    }


def _forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States (2, time, lanes, hidden) of bytes (2, time, lanes), whose second part is reversed in time.

    The first two thirds of the gates are the update and reset gates, the last third the candidate.
    Byte 256 is padding and holds the state, so that a window starts with its first byte in either direction.
    """
    _, steps, lanes = x.shape
    h = np.zeros((2, lanes, HIDDEN), p["x"].dtype)
    states = np.empty((2, steps, lanes, HIDDEN), h.dtype)
    tape = []
    two = 2 * HIDDEN
    held = (x == 256)[..., None]
    some_held = held.any(axis=(0, 2, 3))
    for t in range(steps):
        gates = np.stack([p["x"][0].take(x[0, t], 0), p["x"][1].take(x[1, t], 0)])
        inner = h @ p["u"]
        zr = gates[..., :two] + inner[..., :two]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        n = np.tanh(gates[..., two:] + r * inner[..., two:])
        if some_held[t]:
            z = np.where(held[:, t], 1, z)
        tape.append((h, z, r, n, inner[..., two:]))
        h = n + z * (h - n)
        states[:, t] = h
    return states, tape


class Reader:
    """The same recurrence without a tape: every gate in an array of its own, buffers reused."""

    def __init__(self, p: dict[str, np.ndarray]):
        half = (0.5, 0.5, 1.0)  # the update and reset gates are 0.5 + 0.5 tanh of half their input
        cut = [slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(3)]
        self.tables = [np.ascontiguousarray(p["x"][:, :, c].reshape(-1, HIDDEN) * f, np.float32) for c, f in zip(cut, half)]
        self.tables[0][[256, 513]] = 1e3  # padding holds the state
        self.inner = [np.ascontiguousarray(p["u"][:, :, c] * f, np.float32) for c, f in zip(cut, half)]
        self.out = [np.ascontiguousarray(o.T, np.float32) for o in (p["o"][:HIDDEN], p["o"][HIDDEN:])]
        self.bias = p["b"].astype(np.float32)[:, None]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(languages, time, lanes) for bytes (time, lanes); languages first, so that sums over them run along memory."""
        states = self.states(x)
        forth, back = (np.ascontiguousarray(s).reshape(-1, HIDDEN) for s in (states[0], states[1, ::-1]))
        logits = self.out[0] @ forth.T
        logits += self.out[1] @ back.T
        logits += self.bias
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits.reshape(-1, *x.shape)

    def states(self, x: np.ndarray) -> np.ndarray:
        """(2, time, lanes, hidden) of bytes (time, lanes)."""
        steps, lanes = x.shape
        both = np.stack([x, x[::-1] + 257], axis=1)
        shape = (2, lanes, HIDDEN)
        h = np.zeros(shape, np.float32)
        gates = [np.empty(shape, np.float32) for _ in range(3)]
        hidden = [np.empty(shape, np.float32) for _ in range(3)]
        out = np.empty((steps, *shape), np.float32)
        z, r, n = gates
        for t in range(steps):
            for k in range(3):
                np.take(self.tables[k], both[t], axis=0, out=gates[k], mode="clip")
                np.matmul(h, self.inner[k], out=hidden[k])
            r += hidden[1]
            np.tanh(r, out=r)
            r += 1
            r *= 0.5
            r *= hidden[2]
            n += r
            np.tanh(n, out=n)
            z += hidden[0]
            np.tanh(z, out=z)
            z += 1
            z *= 0.5
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out.transpose(1, 0, 2, 3)


def _together(states: np.ndarray) -> np.ndarray:
    """(time, lanes, 2 hidden): both directions at each position."""
    return np.concatenate([states[0], states[1, ::-1]], axis=2)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of bytes (time, lanes) with labels (lanes), and its gradients."""
    both = np.stack([x, x[::-1]])
    states, tape = _forward(p, both)
    joined = _together(states)
    prob = _softmax(joined @ p["o"] + p["b"])
    real = (x != 256).astype(prob.dtype)
    total = max(real.sum(), 1)
    lanes = np.arange(x.shape[1])
    loss = -(np.log(prob[:, lanes, y] + 1e-12) * real).sum() / total
    d = prob.copy()
    d[:, lanes, y] -= 1
    d *= real[..., None] / total
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["o"] = np.einsum("tlh,tlc->hc", joined, d)
    grads["b"] = d.sum((0, 1))
    back = d @ p["o"].T
    d_states = np.stack([back[..., :HIDDEN], back[::-1, :, HIDDEN:]])
    carry = np.zeros_like(states[:, 0])
    for t in range(x.shape[0] - 1, -1, -1):
        h, z, r, n, inner_n = tape[t]
        dh = d_states[:, t] + carry
        dz = dh * (h - n) * z * (1 - z)
        dn = dh * (1 - z) * (1 - n * n)
        dr = dn * inner_n * r * (1 - r)
        at_gates = np.concatenate([dz, dr, dn], axis=2)
        at_inner = np.concatenate([dz, dr, dn * r], axis=2)
        for way in (0, 1):
            np.add.at(grads["x"][way], both[way, t], at_gates[way])
        grads["u"] += h.transpose(0, 2, 1) @ at_inner
        carry = dh * z + at_inner @ p["u"].transpose(0, 2, 1)
    return float(loss), grads


@dataclass(frozen=True)
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean of the position probabilities of each whole text; zeros for an empty one."""
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // WINDOW) for t in texts])
        pieces = [t[i:i + WINDOW] for t in texts for i in range(0, len(t), WINDOW)]
        order = np.argsort([-len(w) for w in pieces], kind="stable")
        reader = Reader(self.weights)
        sums = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(order), LANES):
            mine = order[at:at + LANES]
            lengths = np.array([len(pieces[i]) for i in mine])
            x = np.full((len(mine), lengths[0]), 256, np.int64)
            for k, i in enumerate(mine):
                x[k, :lengths[k]] = np.frombuffer(pieces[i], np.uint8)
            x = np.ascontiguousarray(x.T)
            prob = reader.probabilities(x)
            prob *= x != 256
            np.add.at(sums, owner[mine], prob.sum(1, dtype=np.float64).T)
        size = np.array([len(t) for t in texts], np.float64)
        return sums / np.maximum(size, 1)[:, None]


def train(texts: list[bytes], labels: list[str], seed: int = 0, steps: int = STEPS) -> Network:
    """Fit by Adam on evenly spaced windows of the texts, all languages equally often."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    by: dict[int, list[bytes]] = {i: [] for i in range(len(languages))}
    for t, label in zip(texts, labels):
        room = max(len(t) - TRAIN_WINDOW, 0)
        for k in range(WINDOWS_A_TEXT if room else 1):
            at = room * k // max(WINDOWS_A_TEXT - 1, 1)
            if w := t[at:at + TRAIN_WINDOW]:
                by[languages.index(label)].append(w)
    by = {i: w for i, w in by.items() if w}
    p = _start(len(languages), seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if len(by) > 1 else 1):
        y = rng.choice(np.array(sorted(by)), BATCH)
        x = np.full((BATCH, TRAIN_WINDOW), 256, np.int64)
        for lane, label in enumerate(y):
            w = by[label][rng.integers(len(by[label]))]
            x[lane, :len(w)] = np.frombuffer(w, np.uint8)
        _, g = loss_and_gradients(p, np.ascontiguousarray(x.T), y)
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Network(languages, {k: a.astype(np.float32) for k, a in p.items()})


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Train on at most ``sample_rows`` documents outside the held-out fold, in hash order.

    Of each, ``WINDOWS_A_TEXT`` evenly spaced windows reach the driver; rows without text or label don't.
    """
    taught = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_t"), F.col("lang").cast("string").alias("_y")).filter(
        "_t IS NOT NULL AND _y IS NOT NULL").filter(fold(F.col("_id"), FOLDS) != HELD_OUT)
    room = F.greatest(F.length("_t") - TRAIN_WINDOW, F.lit(0))
    cuts = F.array(*[
        F.substring("_t", (F.floor(room * k / max(WINDOWS_A_TEXT - 1, 1)) + 1).cast("int"), F.lit(TRAIN_WINDOW)) for k in range(WINDOWS_A_TEXT)
    ])
    picked = bounded_sample(taught, F.xxhash64("_id", "_y", "_t", F.lit(3)), sample_rows).select("_y", cuts.alias("_w"))
    rows = [(w.encode(), r["_y"]) for r in picked.collect() for w in r["_w"]]
    return train([w for w, _ in rows], [y for _, y in rows])


def probabilities(network: Network, text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(network.documents(text_bytes(texts)).tolist(), pa.list_(pa.float64()))

    return run(text.cast("string"))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; ``score`` is the predicted language's mean probability.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no labelled
    row taught a language. Repeated ids give a row each, an empty table none. Only the text is read for a prediction.
    """
    bounded_batches(docs.sparkSession)
    network = fit(docs, sample_rows)
    held = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    if not network.languages:
        return docs.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    readable = F.coalesce(F.col("text").cast("string").rlike("\\p{L}"), F.lit(False))
    read = docs.select("doc_id", held, readable.alias("_ok"), probabilities(network, F.col("text")).alias("_p"))
    names = F.array(*map(F.lit, network.languages))
    best = F.array_max("_p")
    return read.select(
        "doc_id", "held_out",
        F.when(F.col("_ok"), F.element_at(names, F.array_position("_p", best).cast("int"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_ok"), F.least(F.lit(1.0), best)).otherwise(0.0).alias("score"),
    )
