"""Keyword index and BM25 retrieval for whole batches of queries.

The corpus is tokenised once and stored by row, each with its counted words, beside document
frequencies and two totals; nothing is shuffled for that. A batch of queries reads the postings of its
terms, restricted to the ids it may return while the statistics stay those of the whole index. Matching
postings are dealt out by row, so that the scores of a row are summed where they lie and the pairs of queries
and rows are never sent. The per-query top-k is cut inside every task before the final exchange, so a query that
matches a third of the corpus never sends more than k rows per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions import text as tx
from veridoc.session import computed, few, shuffled, stored
from veridoc.sources.buckets import Change, create_store, current_state, read_keys, read_table, replace_documents

# --- fixed values -----------------------------------------------------------
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
KEYWORD_TOP_K = 12
# --- end of fixed values ----------------------------------------------------
RANK_SCALE = 9  # scores are compared at this many decimals, so rank never depends on sum order


def tokenised(docs: DataFrame, id_col: str, text_cols: list[str], cjk: bool = True) -> DataFrame:
    """(id, tokens, dl): words of all indexed columns plus the CJK grams of the first one."""
    parts = [tx.index_tokens(F.col(c)) for c in text_cols]
    if cjk:
        body = F.coalesce(F.col(text_cols[0]), F.lit(""))
        grams = tx.cjk_bigram_list(tx.norm_search(body, compose=False))
        parts.append(F.when(body.rlike("[" + tx.CJK + "]"), grams).otherwise(F.array().cast("array<string>")))
    tokens = F.concat(*parts) if len(parts) > 1 else parts[0]
    return computed(docs, "tokens", tokens, F.col(id_col).alias("id")).withColumn("dl", F.size("tokens"))


def word_counts(tokens: Column) -> Column:
    """The distinct words of a list with their counts: runs of the sorted list, so a row is counted without a shuffle."""
    def runs(words: Column) -> Column:
        n = F.size(words)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return tx.let(starts, lambda at: F.transform(
            at, lambda i, j: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(at, j + 1), n) - i).cast("long").alias("tf"))
        ))

    return F.when(F.size(tokens) > 0, tx.let(F.sort_array(tokens), runs))


def row_postings(tokens: DataFrame) -> DataFrame:
    """(term, id, tf, dl): one row per word of each row; for tokens whose ids do not repeat, these are the postings."""
    return _row_words(counted_rows(tokens))


def counted_rows(tokens: DataFrame) -> DataFrame:
    """(id, dl, words): every row with its distinct words and their counts."""
    return computed(tokens, "words", word_counts(F.col("tokens")), "id", "dl")


def _row_words(rows: DataFrame) -> DataFrame:
    return rows.select("id", "dl", F.inline("words")).select("term", "id", "tf", "dl")


def merged_postings(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def build_postings(tokens: DataFrame) -> DataFrame:
    """(term, id, tf, dl): one row per word and document, also where an id has several rows."""
    return merged_postings(row_postings(tokens))


def index_stats(tokens: DataFrame) -> DataFrame:
    """One row: number of indexed rows and their mean length (the full index, not the eligible part)."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency per word.

    The count reads ``tf`` and ``dl`` (never zero in a posting): with the same columns in use
    the planner reuses the shuffled postings instead of tokenising the corpus again.
    """
    return postings.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("dl") > 0)).alias("df"))


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf, dl), terms (term, df) and one row of totals (n, avgdl) over all indexed rows."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def build_index(tokens: DataFrame) -> Index:
    postings = build_postings(tokens)
    return Index(postings, term_stats(postings), index_stats(tokens))


def save_index(tokens: DataFrame, path: str) -> Index:
    """Tokenise once and store the index by row; counts are taken from what is stored."""
    spark = tokens.sparkSession
    counted_rows(tokens).write.parquet(f"{path}/rows/part=0")
    rows = spark.read.parquet(f"{path}/rows/part=0")
    index_stats(rows).write.parquet(f"{path}/totals")
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if not repeated.isEmpty():
        # rows of one id are merged, and those of all other ids kept, as a second part that replaces the first
        counted = merged_postings(_row_words(rows.join(shuffled(repeated), rows["id"].eqNullSafe(repeated["id"]), "left_semi")))
        merged = counted.groupBy("id").agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("words"))
        single = rows.join(shuffled(repeated), rows["id"].eqNullSafe(repeated["id"]), "left_anti")
        single.unionByName(merged).write.parquet(f"{path}/rows/part=1")
    term_stats(_stored_postings(spark, path)).write.parquet(f"{path}/terms")
    return load_index(spark, path)


def _stored_postings(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(f"{path}/rows")
    newest = parts.agg(F.max("part")).first()[0]
    return _row_words(parts.where(F.col("part") == newest).drop("part"))


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(_stored_postings(spark, path), *(spark.read.parquet(f"{path}/{name}") for name in ("terms", "totals")))


def _counted_once(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (term, id, tf, dl) and lengths (id, dl) of rows that are tokenised and stored once; rows of one id are merged."""
    rows = stored(counted_rows(tokens), "counted")
    postings = _row_words(rows)
    repeated = not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return merged_postings(postings) if repeated else postings, rows.select("id", "dl")


def create_live_index(tokens: DataFrame, store: str, buckets: int) -> Index:
    """An index that follows its documents: postings and lengths lie in buckets by document, counts in buckets by term."""
    spark = tokens.sparkSession
    postings, lengths = _counted_once(tokens)
    tables = {"postings": (postings, "id"), "lengths": (lengths, "id"), "terms": (term_stats(postings), "term")}
    create_store(spark, store, tables, buckets)
    return load_live_index(spark, store)


def load_live_index(spark: SparkSession, store: str) -> Index:
    postings, terms, lengths = (read_table(spark, store, name) for name in ("postings", "terms", "lengths"))
    return Index(postings, terms, index_stats(lengths))


def update_live_index(store: str, tokens: DataFrame, gone: DataFrame) -> dict[str, list[int]]:
    """Replace the documents of ``tokens`` and remove those of ``gone`` (id), as one new state; returns the rewritten buckets.

    Document frequencies move by what the old postings of these documents take away and the new ones bring; terms
    that nobody holds any more leave the index.
    """
    spark = tokens.sparkSession
    since = current_state(spark, store)[0]
    postings, lengths = _counted_once(tokens)
    ids = lengths.select("id").unionByName(gone.select("id")).distinct()
    old = read_keys(spark, store, "postings", ids)
    steps = old.select("term", F.lit(-1).alias("step")).unionByName(postings.select("term", F.lit(1).alias("step")))
    moved = steps.groupBy("term").agg(F.sum("step").alias("step")).filter("step <> 0")
    known = read_keys(spark, store, "terms", moved)
    counts = moved.join(known, "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("step")).alias("df"))
    return replace_documents(spark, store, [
        Change("postings", postings, ids, True), Change("lengths", lengths, ids, True),
        Change("terms", counts.filter("df > 0"), moved.select("term"), True),
    ], since)


def match_plan(
    queries: DataFrame, id_col: str, text_col: str, compose: bool = False, max_terms: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """Disjunctive form of the AND and the OR expression of every query.

    One row per (query_id, mode, conjunct, token) with the conjunct's size. AND binds
    tighter than OR: a loose term splits the AND expression into several conjuncts.
    Queries over 400 characters are rejected and blank ones have no rows here;
    ``query_status`` names both, and what explicit ``max_terms`` and ``max_chars`` would cut.
    """
    terms = tx.query_terms(F.col(text_col), compose, max_terms)
    q = queries.where(F.length(text_col) <= tx.MAX_QUERY_CHARS).select(
        F.col(id_col).alias("query_id"), F.posexplode(terms).alias("term_no", "term")
    )
    q = q.select(
        "query_id", "term_no",
        tx.term_tokens(F.col("term"), max_chars).alias("tokens"),
        tx.term_is_loose(F.col("term")).alias("loose"),
    ).where(F.size("tokens") > 0)
    # OR pieces of one term: a loose term gives one piece per token, any other a single piece
    pieces = q.select(
        "query_id", "term_no",
        F.posexplode(
            F.when(F.col("loose"), F.transform("tokens", lambda t: F.array(t))).otherwise(
                F.array("tokens")
            )
        ).alias("piece_no", "piece"),
    )
    # a query has at most 400 characters, so this window partition is bounded
    w = Window.partitionBy("query_id").orderBy("term_no", "piece_no")
    pieces = pieces.withColumn(
        "and_conj", F.sum(F.when(F.col("piece_no") > 0, 1).otherwise(0)).over(w)
    ).withColumn("or_conj", F.row_number().over(w))
    rows = pieces.select(
        "query_id",
        F.explode(
            F.array(
                F.struct(F.lit("and").alias("mode"), F.col("and_conj").cast("int").alias("conj")),
                F.struct(F.lit("or").alias("mode"), F.col("or_conj").cast("int").alias("conj")),
            )
        ).alias("m"),
        "piece",
    ).select("query_id", "m.mode", "m.conj", F.explode("piece").alias("token"))
    rows = rows.withColumn("token", tx.fold_accents(F.col("token")))
    distinct = rows.groupBy("query_id", "mode", "conj", "token").agg(F.count(F.lit(1)).alias("mult"))
    size = distinct.groupBy("query_id", "mode", "conj").agg(F.count(F.lit(1)).alias("conj_size"))
    return distinct.join(shuffled(size), ["query_id", "mode", "conj"])


def query_status(
    queries: DataFrame, id_col: str, text_col: str, max_terms: int = tx.MAX_TERMS, max_chars: int = tx.MAX_TERM_CHARS
) -> DataFrame:
    """Per query: status, and the terms beyond ``max_terms`` and over ``max_chars`` that such limits would cut."""
    listed = tx.query_terms(F.col(text_col), compose=False)
    terms = F.size(listed)
    return queries.select(
        F.col(id_col).alias("query_id"),
        F.greatest(terms - max_terms, F.lit(0)).alias("terms_over"),
        F.size(F.filter(listed, lambda t: F.length(t) > max_chars)).alias("long_terms"),
        F.when(F.length(text_col) > tx.MAX_QUERY_CHARS, F.lit("query_too_long"))
        .when(terms == 0, F.lit("empty"))
        .otherwise(F.lit("searchable"))
        .alias("status"),
    )


def _weight(n, avgdl):
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def keyword_matches(index: Index, plan: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """All matching (query_id, id, score, mode): AND hits where the query has any, else OR hits.

    ``allowed`` (id) restricts what may be returned; weights keep the statistics of the whole index,
    and whether a query has AND hits is decided among the allowed rows.
    """
    per_doc = _judged(index, plan, allowed)
    with_and = per_doc.where("is_and").select("query_id").distinct().withColumn("has_and", F.lit(True))
    return (
        per_doc.join(shuffled(with_and), "query_id", "left")
        .where(F.col("is_and") | (F.col("has_and").isNull() & F.col("is_or")))
        .select(
            "query_id", "id", F.round("raw", RANK_SCALE).alias("score"),
            F.when(F.col("has_and"), F.lit("and")).otherwise(F.lit("or")).alias("mode"),
        )
    )


def best_matches(index: Index, plan: DataFrame, k: int = KEYWORD_TOP_K, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank, mode): the best ``k`` of ``keyword_matches``, score descending, id ascending.

    AND hits stand before all others, so a query's first ``k`` rows tell whether it has any: the pairs of queries and rows are
    cut inside the tasks and none is sent to learn that.
    """
    query = Window.partitionBy("query_id")
    scored = _judged(index, plan, allowed).withColumn("score", F.round("raw", RANK_SCALE))
    ranked = scored.withColumn("rank", F.row_number().over(query.orderBy(F.col("is_and").desc(), F.col("score").desc(), F.col("id"))))
    first = ranked.where(F.col("rank") <= k).withColumn("has_and", F.max("is_and").over(query))
    mode = F.when(F.col("has_and"), F.lit("and")).otherwise(F.lit("or"))
    return first.where(F.col("is_and") | ~F.col("has_and")).select("query_id", "id", "score", "rank", mode.alias("mode"))


PAIRS_A_TASK = 8_000_000  # matches that a task sums, two groups of some 60 bytes for each row it holds at most


def _judged(index: Index, plan: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(query_id, id, raw, is_and, is_or): every row that meets an expression of a query.

    The weights of a row are dealt out together, to as many tasks as their counted matches ask for. Where the plan is small
    it goes to all of them, and pairs of queries and rows are summed where they lie.
    """
    spark = plan.sparkSession
    totals = index.totals.select(F.struct("n", "avgdl").alias("s")).scalar()
    # words that no row holds find nothing; the rest of the plan grows with the queries and meets the terms by shuffle
    known = stored(shuffled(plan.withColumnRenamed("token", "term")).join(index.terms.select("term", "df"), "term"), "plan")
    matches = known.agg(F.sum("df")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-matches // PAIRS_A_TASK))
    weighted = index.postings.join(few(known.select("term", "df").distinct()), "term").select("id", "term", _weight(totals["n"], totals["avgdl"]).alias("w"))
    dealt = weighted.repartition(parts, "id")
    if allowed is not None:
        dealt = dealt.join(shuffled(allowed.select("id").distinct()), "id", "left_semi")
    # an OR piece of one word is complete with it: all such pieces of a query are one group
    single = (F.col("mode") == "or") & (F.col("conj_size") == 1)
    asked = known.drop("df").withColumn("conj", F.when(single, F.lit(-1)).otherwise(F.col("conj")))
    per_conj = dealt.join(few(asked), "term").groupBy("query_id", "id", "mode", "conj", "conj_size").agg(
        F.count(F.lit(1)).alias("found"), F.sum(F.col("w") * F.col("mult")).alias("s")
    )
    complete = F.col("found") >= F.col("conj_size")
    # every phrase of the expression occurs exactly once on the OR side: its sum is the score
    return per_conj.groupBy("query_id", "id").agg(
        F.sum(F.when(F.col("mode") == "or", F.col("s")).otherwise(0.0)).alias("raw"),
        F.max((F.col("mode") == "and") & complete).alias("is_and"),
        F.max((F.col("mode") == "or") & complete).alias("is_or"),
    ).where(F.col("is_and") | F.col("is_or"))


def bm25_scores(index: Index, query_tokens: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) for any shared token; ``query_tokens`` is (query_id, token), repeats count.

    ``allowed`` (id) restricts what may be returned; the statistics stay those of the whole index.
    """
    q = query_tokens.groupBy("query_id", F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("mult"))
    totals = index.totals.select(F.struct("n", "avgdl").alias("s")).scalar()
    terms = few(index.terms.join(shuffled(q.select("term").distinct()), "term", "left_semi"))
    # the weights of a row are dealt out together: joins and sums below need no further exchange where the queries are few
    dealt = index.postings.join(terms, "term").select("id", "term", _weight(totals["n"], totals["avgdl"]).alias("_w")).repartition("id")
    if allowed is not None:
        dealt = dealt.join(shuffled(allowed.select("id").distinct()), "id", "left_semi")
    return (
        dealt.join(few(q), "term")
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(F.col("_w") * F.col("mult")), RANK_SCALE).alias("score"))
    )


def top_k(scores: DataFrame, k: int = KEYWORD_TOP_K, extra: tuple[str, ...] = ()) -> DataFrame:
    """Best k rows per query: score descending, id ascending."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (
        scores.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "id", "score", "rank", *extra)
    )
