"""Exact substring tests between two text tables without pairing them.

A common window of width w always holds one gram of q characters that starts at a multiple
of ``w - q + 1`` in the longer text. Those few grams are looked up first; only places that
survive are compared window by window. Both steps are semi-joins on distinct short texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions import text as tx
from veridoc.session import computed, few, stored

SHORT_GRAMS = (16, 8, 4, 2, 1)


def pieces(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def windows(text: Column, width: int) -> Column:
    """All distinct windows of ``width`` characters."""
    def per_piece(ps: Column) -> Column:
        def starts(p: Column, i: Column) -> Column:
            return tx.let(
                F.concat(p, F.coalesce(F.get(ps, i + 1), F.lit(""))),
                lambda ctx: F.transform(
                    F.sequence(F.lit(1), F.length(p)), lambda k: F.substring(ctx, k, F.lit(width))
                ),
            )

        return F.array_distinct(F.filter(F.flatten(F.transform(ps, starts)), lambda x: F.length(x) == width))

    return tx.let(pieces(text, width), per_piece)


def anchors(text: Column, stride: int, q: int) -> Column:
    """array<struct<gram, context, offset>>: the gram at every multiple of ``stride``.

    ``context`` is the piece before, the piece itself and the piece after; ``offset`` is the
    gram's 0-based place inside it.
    """
    def build(ps: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ps, i - 1)).otherwise(F.lit(""))
            after = F.coalesce(F.get(ps, i + 1), F.lit(""))
            return F.struct(
                F.substring(F.concat(p, after), 1, q).alias("gram"), F.concat(before, p, after).alias("context"),
                F.length(before).alias("offset"),
            )

        return F.filter(F.transform(ps, one), lambda a: F.length(a["gram"]) == q)

    return tx.let(pieces(text, stride), build)


def sampled_grams(text: Column, stride: int, q: int) -> Column:
    """The distinct grams of ``anchors`` alone."""
    def build(ps: Column) -> Column:
        grams = F.transform(ps, lambda p, i: F.substring(F.concat(p, F.coalesce(F.get(ps, i + 1), F.lit(""))), 1, q))
        return F.array_distinct(F.filter(grams, lambda g: F.length(g) == q))

    return tx.let(pieces(text, stride), build)


def leaked_windows(answers: DataFrame, protected: DataFrame, width: int = 20) -> DataFrame:
    """Per answer (id, text): number of distinct protected windows it contains.

    Texts are trimmed; a protected text shorter than the window protects nothing.
    """
    q = width // 2
    stride = width - q + 1
    secret = protected.select(tx.strip_ws(F.col("text")).alias("text")).where(F.length("text") >= width)
    secret_windows = secret.select(F.explode(windows(F.col("text"), width)).alias("window")).distinct()
    secret_grams = secret.select(F.explode(windows(F.col("text"), q)).alias("gram")).distinct()
    spots = answers.select("id", F.explode(anchors(tx.strip_ws(F.col("text")), stride, q)).alias("a")).select(
        "id", "a.gram", "a.context", "a.offset"
    )
    live = spots.join(secret_grams, "gram", "left_semi")
    first = F.greatest(F.col("offset") - (width - q), F.lit(0))
    last = F.least(F.col("offset"), F.length("context") - width)
    candidates = live.where(last >= first).select(
        "id", F.explode(F.transform(F.sequence(first, last), lambda k: F.substring(F.col("context"), k + 1, F.lit(width)))).alias("window")
    )
    hits = candidates.join(secret_windows, "window", "left_semi").groupBy("id").agg(F.count_distinct("window").alias("n_windows"))
    return answers.select("id").join(hits, "id", "left").select(
        "id", F.coalesce("n_windows", F.lit(0)).cast("bigint").alias("n_windows"), F.col("n_windows").isNotNull().alias("leaked")
    )


def containing(texts: DataFrame, needles: DataFrame, q: int = 24, stride: int = 16) -> DataFrame:
    """(id, needle_id) where the text contains the whole needle; an empty needle is in none.

    A needle of at least ``q + stride - 1`` characters covers one sampled gram of any text it occurs
    in. Shorter needles are looked up by a gram of 16, 8, 4, 2 or 1 characters, the widest that fits, at
    every place; only the widths that some needle needs are read. Candidates are confirmed on the texts.
    """
    size = F.length("needle")
    width = F.when(size >= q + stride - 1, 0)
    for w in SHORT_GRAMS:
        width = width.when(size >= w, w)
    sized = needles.select("needle_id", "needle", width.alias("w")).where("w IS NOT NULL")
    pairs = None
    for (w,) in sorted(sized.select("w").distinct().collect()):  # at most six values
        mine = sized.where(F.col("w") == w)
        if w:
            grams = mine.select("needle_id", F.substring("needle", 1, w).alias("gram"))
            spots = computed(texts, "grams", windows(F.col("text"), w), "id").select("id", F.explode("grams").alias("gram"))
        else:
            sampled = F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda k: F.substring(F.col("needle"), k, F.lit(q)))
            grams = mine.select("needle_id", F.explode(F.array_distinct(sampled)).alias("gram"))
            spots = computed(texts, "grams", sampled_grams(F.col("text"), stride, q), "id").select("id", F.explode("grams").alias("gram"))
        found = spots.join(few(grams), "gram").select("id", "needle_id").distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return texts.select("id").join(needles.select("needle_id"), F.lit(False))
    pairs = stored(pairs, "pairs")
    held = texts.join(few(pairs.select("id").distinct()), "id", "left_semi")
    return (
        pairs.join(held, "id").join(needles, "needle_id").where(F.contains("text", F.col("needle"))).select("id", "needle_id")
    )
