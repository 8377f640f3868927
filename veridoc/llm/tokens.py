"""Token counts under a unigram model, with one dynamic programme for all words that share a prefix.

The pieces are those of a public sentencepiece vocabulary. Their log-probabilities follow Zipf's law
over the rank that the vocabulary lists: log p = -log(rank + 1) - log of the harmonic sum, and a
character without a piece costs its UTF-8 bytes, each as improbable as the last rank. A pre-token is a run
of other than white space with the word mark before it; its best segmentation is the most probable
one, of equals the one with fewer tokens.

Distinct pre-tokens become a trie. A node is a prefix and holds the best score of its segmentation and the
number of tokens there; it needs only the nodes above it, so a prefix is scored once however many
words continue it. Terminals are the counts, and a text's count is their sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import bounded_batches

MARK = "▁"
TRIE_NODES = 800_000  # a worker's trie starts anew beyond it; counts don't depend on it


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[dict[str, float], float]:
    """(log-probability by piece, that of one byte) of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain) + 1)))
    pieces: dict[str, float] = {}
    for rank, piece in enumerate(plain):
        pieces.setdefault(piece, -math.log(rank + 1) - total)
    return pieces, -math.log(len(plain) + 1) - total


class Trie:
    """Prefixes of pre-tokens with the best score and token count of each.

    ``endings`` holds every suffix of every piece, with the piece's score where it is one itself: the
    pieces that end at a character are found by going back until the stretch ends no piece.
    """

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.byte_score = byte_score
        self.endings: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(len(p))}
        self.endings.update(pieces)
        self.clear()

    def clear(self) -> None:
        self.nodes: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def tokens(self, word: str) -> int:
        """Number of tokens of one word; walks known nodes and scores the new ones."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        text = MARK + word
        path, node, nodes = [0], 0, self.nodes
        for end, c in enumerate(text, 1):
            child = nodes.get((node, c))
            if child is None:
                child = self._grow(path, node, text, end, c)
            node = child
            path.append(node)
        self.terminal[word] = self.count[node]
        return self.count[node]

    def _grow(self, path: list[int], node: int, text: str, end: int, c: str) -> int:
        score, count, endings = self.score, self.count, self.endings
        size = len(c.encode())
        best, least = score[node] + size * self.byte_score, count[node] + size
        start = end - 1
        while start >= 0:
            piece = endings.get(text[start:end], 0)
            if piece == 0:  # ends no piece; a log-probability is never 0
                break
            if piece is not None:
                above = path[start]
                total = score[above] + piece
                if total > best or total == best and count[above] + 1 < least:
                    best, least = total, count[above] + 1
            start -= 1
        self.nodes[node, c] = len(score)
        score.append(best)
        count.append(least)
        return len(score) - 1


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row; null and empty texts have none.

    The vocabulary's path must be readable by every task. Repeated ids give a row each, an empty table
    none; other columns are not looked at. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*load_pieces(path))
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1).to_pylist():
                if len(trie.score) > TRIE_NODES:
                    trie.clear()
                split = (t or "").split()
                words.append(len(split))
                known = trie.terminal.get
                tokens.append(sum(known(w) or trie.tokens(w) for w in split))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
