import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names clash with what the operators derive
    T.StructField("score", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table with clashing columns from (doc_id, text, lang, source) tuples."""
    def build(rows):
        full = [(i, t, lang, src, len(t) if t is not None else None, "x", "y", 7, 8) for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose of many different words."""
    import random

    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "ol")]

    def make(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))

    return make
