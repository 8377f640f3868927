"""Retrieval queries over documents, embeddings and benchmark questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions import digest as dg
from veridoc.functions import text as tx
from veridoc.operators import bounded, fusion, keyword, vectors
from veridoc.plans.registry import query
from veridoc.session import Tables, checkpoint_root, few, shuffled, stored

DIM = 64
INDEXED = ["text", "lang", "source"]

# --- shared SQL ---------------------------------------------------------------
_WORDS = r"list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
INDEX_SQL = f"""
tok AS (SELECT doc_id AS id, unnest({_WORDS.format("text || ' ' || lang || ' ' || source")}) AS term
        FROM documents),
dl AS (SELECT id, count(*)::DOUBLE AS dl FROM tok GROUP BY id),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM tok GROUP BY id, term),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
w AS (SELECT tf.id, tf.term,
             greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
               / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w
      FROM tf JOIN df USING (term) JOIN dl USING (id), stats)"""
KEYWORD_SQL = f"""{INDEX_SQL},
qm AS (SELECT query_id, term, count(*) AS mult
       FROM (SELECT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark)
       GROUP BY ALL),
kw AS (SELECT query_id, id, round(sum(w * mult), 9) AS score
       FROM qm JOIN w USING (term) GROUP BY query_id, id),
kwtop AS (SELECT query_id, id, score,
                 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
          FROM kw QUALIFY rank <= 12)"""
VECTOR_SQL = f"""
qraw AS (SELECT item_id AS query_id,
                [CAST(CAST('0x' || substr(sha256(unhex(sha256(text) || printf('%08x', i // 8))),
                      (i % 8) * 8 + 1, 8) AS UBIGINT) AS DOUBLE) / 4294967295.0 * 2.0 - 1.0
                 FOR i IN range({DIM})] AS v
         FROM benchmark),
qv AS (SELECT query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v
       FROM qraw),
vec AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vd AS (SELECT query_id, id, label,
              round(list_sum(list_transform(range(1, {DIM} + 1),
                    lambda i: (qv.v[i] - vec.v[i]) * (qv.v[i] - vec.v[i]))), 9) AS distance
       FROM qv, vec),
vtop AS (SELECT query_id, id, distance,
                row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
         FROM vd QUALIFY rank <= 12)"""
FUSED_SQL = f"""{KEYWORD_SQL}, {VECTOR_SQL},
both_ AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id,
                 v.rank AS dense_rank, k.rank AS keyword_rank
          FROM vtop v FULL OUTER JOIN kwtop k ON v.query_id = k.query_id AND v.id = k.id),
fused AS (SELECT *, round(coalesce(1.0 / (dense_rank + 60), 0) + coalesce(1.0 / (keyword_rank + 60), 0), 12)
                      AS fused_score,
                 least(coalesce(dense_rank, 999999), coalesce(keyword_rank, 999999)) AS best_rank
          FROM both_),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, best_rank, id) AS fused_rank
       FROM fused)"""
SCORED_SQL = f"""{FUSED_SQL},
cand AS (SELECT fr.*, b.text AS qtext,
                coalesce(d.text, '') || chr(10) ||
                CASE WHEN d.doc_id IS NULL THEN '{{}}'
                     ELSE '{{"doc_category":"' || d.lang || '","section_title":"' || d.source || '"}}' END AS ctext
         FROM fr JOIN benchmark b ON b.item_id = fr.query_id LEFT JOIN documents d ON d.doc_id = fr.id
         WHERE fused_rank <= 20),
sc AS (SELECT *, CAST(CAST('0x' || substr(sha256(qtext || chr(0) || ctext), 1, 16) AS UBIGINT) AS DOUBLE)
                 / 18446744073709551615.0 AS rerank_score FROM cand)"""
FINAL_SQL = f"""{SCORED_SQL},
final AS (SELECT query_id, id, fused_rank, fused_score, rerank_score,
                 row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_score DESC, id)
                   AS final_rank
          FROM sc QUALIFY final_rank <= 10)"""
DEGRADED_SQL = f"""{SCORED_SQL},
miss AS (SELECT sc.*, CASE WHEN l.toxic = 1 THEN NULL ELSE rerank_score END AS s
         FROM sc LEFT JOIN labels l ON l.doc_id = sc.id),
flag AS (SELECT query_id, bool_or(s IS NULL) AS degraded FROM miss GROUP BY query_id),
dfinal AS (SELECT m.query_id, m.id, m.fused_rank, m.fused_score,
                  CASE WHEN degraded THEN NULL ELSE s END AS rerank_score, degraded,
                  row_number() OVER (PARTITION BY m.query_id ORDER BY
                     CASE WHEN degraded THEN 0 ELSE s END DESC,
                     CASE WHEN degraded THEN fused_rank ELSE 0 END, fused_score DESC, m.id) AS final_rank
           FROM miss m JOIN flag USING (query_id) QUALIFY final_rank <= 10)"""


# --- shared plans ---------------------------------------------------------------

def doc_tokens(t: Tables) -> DataFrame:
    return keyword.tokenised(t.wide("documents"), "doc_id", INDEXED)


_STORED: dict[tuple[str, str], str] = {}


def stored_index(t: Tables) -> keyword.Index:
    """The keyword index of the documents, stored once per application and data folder in the shared folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORED:
        path = f"{checkpoint_root(t.spark)}/keyword-{uuid.uuid4().hex}"
        keyword.save_index(doc_tokens(t), path)
        _STORED[key] = path
    return keyword.load_index(t.spark, _STORED[key])


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def keyword_top(t: Tables, allowed: DataFrame | None = None) -> DataFrame:
    q = questions(t).select("query_id", F.explode(tx.index_tokens(F.col("text"))).alias("token"))
    return keyword.top_k(keyword.bm25_scores(stored_index(t), q, allowed))


def query_vectors(t: Tables) -> DataFrame:
    return questions(t).select("query_id", dg.hash_vector(F.col("text"), DIM).alias("v"))


def vector_top(t: Tables, allowed: DataFrame | None = None) -> DataFrame:
    vecs = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    if allowed is not None:
        vecs = vecs.join(allowed, "id", "left_semi")
    return vectors.vector_top_k(query_vectors(t), vecs, DIM)


def fused(t: Tables, limit: int | None = None) -> DataFrame:
    """Ranked once and stored, a few rows a query, for all joins that read them."""
    ranked = stored(fusion.rrf(vector_top(t), keyword_top(t)), "fused")
    return ranked if limit is None else ranked.where(F.col("fused_rank") <= limit)


def with_documents(t: Tables, ranked: DataFrame, *columns: str) -> DataFrame:
    """Ranked rows with columns of their documents, null where there is none; only documents of the list are shuffled."""
    docs = t.documents.select(F.col("doc_id").alias("id"), *columns)
    return ranked.join(docs.join(few(ranked.select("id").distinct()), "id", "left_semi"), "id", "left")


def candidates(t: Tables, limit: int | None = fusion.RERANK_INPUT) -> DataFrame:
    """Fused top 20 with the candidate text a scorer sees."""
    cand = with_documents(t, fused(t, limit=limit), "text", "lang", "source")
    q = questions(t).withColumnRenamed("text", "query_text")
    return stored(cand.join(q, "query_id").withColumn(
        "candidate_text",
        fusion.candidate_text(
            F.col("text"), {"doc_category": F.col("lang"), "section_title": F.col("source")}
        ),
    ), "candidates")


def reranked(t: Tables) -> DataFrame:
    cand = candidates(t)
    scores = fusion.hash_scores(cand, "query_text", "candidate_text")
    return fusion.rerank_merge(cand, scores)


def all_ranks(t: Tables) -> DataFrame:
    """Every fused row with its dense, keyword, fused and final rank, from one retrieval run."""
    score = dg.hash_score(F.col("query_text"), F.col("candidate_text"))
    return fusion.with_final_rank(candidates(t, None).withColumn("rerank_score", score)).select(
        "query_id", "id", "dense_rank", "keyword_rank", "fused_rank", "final_rank"
    )


def degraded(t: Tables) -> DataFrame:
    """The scorer returns nothing for candidates labelled toxic."""
    cand = candidates(t)
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    scores = fusion.hash_scores(cand, "query_text", "candidate_text").join(toxic, "id", "left_anti")
    return fusion.rerank_merge(cand, scores)


# --- queries ---------------------------------------------------------------

@query(
    "keyword_bm25_topk", "R2,R4,R5,R7",
    f"WITH {KEYWORD_SQL} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM kwtop",
)
def keyword_bm25_topk(t: Tables) -> DataFrame:
    return keyword_top(t).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_BOUNDED: dict[str, str] = {}


def bounded_index(t: Tables) -> bounded.BoundedIndex:
    """The stored keyword index, stored once more by impact."""
    stored_index(t)
    path = _STORED[t.spark.sparkContext.applicationId, t.sf_dir]
    if path not in _BOUNDED:
        target = f"{checkpoint_root(t.spark)}/bounded-{uuid.uuid4().hex}"
        bounded.save_bounds(keyword.load_index(t.spark, path), target)
        _BOUNDED[path] = target
    return bounded.load_bounds(t.spark, _BOUNDED[path])


@query(
    "keyword_bounded_topk", "R5,R7",
    f"WITH {KEYWORD_SQL} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM kwtop",
)
def keyword_bounded_topk(t: Tables) -> DataFrame:
    """The same ranks as ``keyword_bm25_topk``, by bounds of words and blocks."""
    q = questions(t).select("query_id", F.explode(tx.index_tokens(F.col("text"))).alias("token"))
    return bounded.bm25_top_k(bounded_index(t), q).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_EDITED = """edited AS (
  SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN source || ' ' || text || ' ' || lang ELSE text END AS text, lang, source
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


@query(
    "keyword_upkeep", "R4,R5,R7,S4,S5",
    f"WITH {_EDITED}, {KEYWORD_SQL.replace('FROM documents', 'FROM edited')} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM kwtop",
)
def keyword_upkeep(t: Tables) -> DataFrame:
    """Search after toxic documents left the stored index and good ones were replaced by longer texts."""
    store = f"{checkpoint_root(t.spark)}/live-{uuid.uuid4().hex}"
    keyword.create_live_index(doc_tokens(t), store, 16)
    gone = t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))
    good = t.labels.where("quality = 1").select("doc_id").join(gone, F.col("doc_id") == F.col("id"), "left_anti")
    longer = t.documents.join(good, "doc_id", "left_semi").withColumn("text", F.concat_ws(" ", "source", "text", "lang"))
    keyword.update_live_index(store, keyword.tokenised(longer, "doc_id", INDEXED), gone)
    q = questions(t).select("query_id", F.explode(tx.index_tokens(F.col("text"))).alias("token"))
    found = keyword.top_k(keyword.bm25_scores(keyword.load_live_index(t.spark, store), q))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_TERMS = r"list_slice(list_filter(regexp_split_to_array(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[^\p{L}\p{N}]+'), lambda t: t <> ''), 1, 64)"


@query(
    "keyword_and_or_fallback", "R2,R3,R6,R7",
    f"""WITH {INDEX_SQL},
qs AS (SELECT item_id AS query_id, text FROM benchmark WHERE length(text) <= 400
       UNION ALL
       SELECT 1000000 + p_partkey, p_name || ' ' || p_type FROM part),
qt AS (SELECT query_id, unnest({_TERMS}) AS raw FROM qs),
qm AS (SELECT query_id, strip_accents(raw) AS term, count(*) AS mult FROM qt GROUP BY ALL),
size_ AS (SELECT query_id, count(*) AS n_terms FROM qm GROUP BY query_id),
hit AS (SELECT query_id, id, round(sum(w * mult), 9) AS score, count(*) AS found
        FROM qm JOIN w USING (term) GROUP BY query_id, id),
flag AS (SELECT hit.*, found = n_terms AS is_and, bool_or(found = n_terms) OVER (PARTITION BY query_id) AS has_and
         FROM hit JOIN size_ USING (query_id)),
top_ AS (SELECT query_id, id, score, CASE WHEN has_and THEN 'and' ELSE 'or' END AS mode,
                row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
         FROM flag WHERE is_and OR NOT has_and QUALIFY rank <= 12)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank, mode FROM top_""",
)
def keyword_and_or_fallback(t: Tables) -> DataFrame:
    qs = questions(t).unionByName(
        t.part.select(
            (F.lit(1000000) + F.col("p_partkey")).alias("query_id"),
            F.concat_ws(" ", "p_name", "p_type").alias("text"),
        )
    )
    # equal questions have equal answers: each text is searched once, for the least id that asks it
    asked = qs.groupBy("query_id").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    texts = asked.groupBy("texts").agg(F.min("query_id").alias("first"))
    searched = qs.join(shuffled(texts.select(F.col("first").alias("query_id"))), "query_id", "left_semi")
    plan = keyword.match_plan(searched, "query_id", "text")
    found = stored(keyword.best_matches(stored_index(t), plan).withColumnRenamed("query_id", "first"), "found")
    return asked.join(few(texts), "texts").join(few(found), "first").select("query_id", "id", F.round("score", 6).alias("score"), "rank", "mode")


@query(
    "query_status", "R6,R8",
    r"""SELECT conv_id * 1000 + turn AS query_id,
CASE WHEN length(text) > 400 THEN 'query_too_long'
     WHEN len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda t: t <> '')) = 0 THEN 'empty'
     ELSE 'searchable' END AS status, greatest(len(ts) - 64, 0)::INT AS terms_over, len(list_filter(ts, lambda t: length(t) > 64))::INT AS long_terms
FROM (SELECT *, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM conversations)""",
)
def query_status(t: Tables) -> DataFrame:
    q = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return keyword.query_status(q, "qid", "text")


@query(
    "index_terms", "R4",
    f"""WITH {INDEX_SQL} SELECT term, df::BIGINT AS df, sum(tf)::BIGINT AS cf, max(tf)::BIGINT AS max_tf
FROM tf JOIN df USING (term) GROUP BY term, df""",
)
def index_terms(t: Tables) -> DataFrame:
    return stored_index(t).postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")
    )


@query(
    "index_statistics", "R4,R5",
    f"""WITH {INDEX_SQL} SELECT n::BIGINT AS n_rows, round(avgdl, 6) AS avg_length,
(SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM tf) AS n_postings FROM stats""",
)
def index_statistics(t: Tables) -> DataFrame:
    index = stored_index(t)
    sums = index.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    return index.totals.select(
        F.col("n").alias("n_rows"), F.round("avgdl", 6).alias("avg_length"),
        sums.select("n_terms").scalar().alias("n_terms"),
        sums.select("n_postings").scalar().alias("n_postings"),
    )


@query(
    "vector_topk", "R8,R22,R23",
    f"""WITH {VECTOR_SQL} SELECT query_id, id, round(distance, 6) AS distance,
round(1.0 / (1.0 + distance), 6) AS score, rank::INT AS rank FROM vtop""",
)
def vector_topk(t: Tables) -> DataFrame:
    return vector_top(t).select(
        "query_id", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank"
    )


@query(
    "vector_topk_filtered", "R8,R9",
    f"""WITH {VECTOR_SQL},
ranked AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
           FROM vd JOIN (SELECT vec_id AS query_id, label AS wanted FROM embeddings) USING (query_id)
           WHERE label = wanted QUALIFY rank <= 12)
SELECT query_id, id, round(distance, 6) AS distance, rank::INT AS rank FROM ranked""",
)
def vector_topk_filtered(t: Tables) -> DataFrame:
    q = query_vectors(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    vecs = t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"
    )
    return vectors.filtered_top_k(q, vecs, "label", DIM).select(
        "query_id", "id", F.round("distance", 6).alias("distance"), "rank"
    )


@query(
    "vector_validation", "R23",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN embedding IS NULL THEN 'missing'
WHEN len(embedding) <> 64 THEN 'dimension_mismatch' ELSE 'ok' END AS reason FROM embeddings) GROUP BY reason""",
)
def vector_validation(t: Tables) -> DataFrame:
    checked = vectors.check_vectors(t.embeddings, DIM, "vec_id")
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "hash_vectors", "R22",
    f"WITH {VECTOR_SQL} SELECT query_id, i::INT AS dim_no, round(v[i], 6) AS x FROM qv, range(1, {DIM} + 1) r(i)",
)
def hash_vectors(t: Tables) -> DataFrame:
    return query_vectors(t).select("query_id", F.posexplode("v").alias("p", "x0")).select(
        "query_id", (F.col("p") + 1).alias("dim_no"), F.round("x0", 6).alias("x")
    )


@query(
    "hybrid_rrf", "R12",
    f"""WITH {FUSED_SQL} SELECT query_id, id, dense_rank::INT AS dense_rank, keyword_rank::INT AS keyword_rank,
round(fused_score, 9) AS fused_score, fused_rank::INT AS fused_rank FROM fr""",
)
def hybrid_rrf(t: Tables) -> DataFrame:
    return fused(t).select(
        "query_id", "id", "dense_rank", "keyword_rank",
        F.round("fused_score", 9).alias("fused_score"), "fused_rank",
    )


@query(
    "rerank_merge", "R13,R14,R16",
    f"""WITH {FINAL_SQL} SELECT query_id, id, fused_rank::INT AS fused_rank,
round(rerank_score, 9) AS rerank_score, final_rank::INT AS final_rank FROM final""",
)
def rerank_merge(t: Tables) -> DataFrame:
    return reranked(t).select(
        "query_id", "id", "fused_rank", F.round("rerank_score", 9).alias("rerank_score"), "final_rank"
    )


@query(
    "rerank_degraded", "R15",
    f"""WITH {DEGRADED_SQL} SELECT query_id, id, fused_rank::INT AS fused_rank,
round(rerank_score, 9) AS rerank_score, NOT degraded AS rerank_applied,
CASE WHEN degraded THEN 'reranker_unavailable' END AS degraded_reason, final_rank::INT AS final_rank FROM dfinal""",
)
def rerank_degraded(t: Tables) -> DataFrame:
    return degraded(t).select(
        "query_id", "id", "fused_rank", F.round("rerank_score", 9).alias("rerank_score"),
        "rerank_applied", "degraded_reason", "final_rank",
    )


@query(
    "answerability", "R19",
    f"""WITH {DEGRADED_SQL},
agg AS (SELECT query_id, count(*) AS n, max(rerank_score) AS best, bool_or(rerank_score IS NULL) AS any_null
        FROM dfinal GROUP BY query_id)
SELECT item_id AS query_id, coalesce(n, 0) AS n_evidence, round(best, 6) AS best_score,
CASE WHEN coalesce(n, 0) = 0 THEN 'no_evidence' WHEN any_null THEN 'score_unavailable'
     WHEN best < 0.95 THEN 'below_score_threshold' END AS reason
FROM benchmark LEFT JOIN agg ON query_id = item_id""",
)
def answerability(t: Tables) -> DataFrame:
    return fusion.answerability(questions(t), degraded(t), 0.95).withColumn(
        "best_score", F.round("best_score", 6)
    )


@query(
    "source_labels", "R17",
    f"""WITH {FINAL_SQL},
src AS (SELECT f.*, coalesce(d.source, 'none') AS source FROM final f LEFT JOIN documents d ON d.doc_id = f.id),
first_ AS (SELECT *, min(final_rank) OVER (PARTITION BY query_id, source) AS fa FROM src)
SELECT query_id, id, final_rank::INT AS final_rank, source,
'S' || dense_rank() OVER (PARTITION BY query_id ORDER BY fa) AS label FROM first_""",
)
def source_labels(t: Tables) -> DataFrame:
    ranked = with_documents(t, reranked(t), "source").withColumn("source", F.coalesce("source", F.lit("none")))
    return fusion.source_labels(ranked, "source").select("query_id", "id", "final_rank", "source", "label")


@query(
    "context_rows", "R18",
    f"""WITH {FINAL_SQL},
src AS (SELECT f.*, d.lang, d.text, coalesce(d.source, 'none') AS source
        FROM final f LEFT JOIN documents d ON d.doc_id = f.id),
first_ AS (SELECT *, min(final_rank) OVER (PARTITION BY query_id, source) AS fa FROM src),
lab AS (SELECT *, 'S' || dense_rank() OVER (PARTITION BY query_id ORDER BY fa) AS label FROM first_)
SELECT query_id, final_rank::INT AS evidence_no,
       '{{"source":"' || label || '"' || CASE WHEN lang IS NULL THEN '' ELSE ',"doc_category":"' || lang || '"' END
       || ',"section_title":"' || source || '"}}' AS meta,
       coalesce(length(text), 0)::INT AS n_chars, sha256(coalesce(text, '')) AS text_sha FROM lab""",
)
def context_rows(t: Tables) -> DataFrame:
    ranked = with_documents(t, reranked(t), "source", "lang", "text").withColumn("source", F.coalesce("source", F.lit("none")))
    text = F.coalesce("text", F.lit(""))
    return fusion.source_labels(ranked, "source").select(
        "query_id", F.col("final_rank").alias("evidence_no"),
        F.to_json(
            F.struct(
                F.col("label").alias("source"), F.col("lang").alias("doc_category"),
                F.col("source").alias("section_title"),
            )
        ).alias("meta"),
        F.length(text).alias("n_chars"), dg.sha256(text).alias("text_sha"),
    )


_LATIN = "abcdefghijklmnopqrstuvwxyz"
_HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


@query(
    "cjk_bigrams", "R1",
    f"""WITH w AS (SELECT p_partkey, unnest(string_split(translate(lower(p_name), '{_LATIN}', '{_HAN}'), ' ')) AS run,
unnest(range(len(string_split(p_name, ' ')))) AS pos FROM part)
SELECT p_partkey, string_agg(CASE WHEN length(run) = 1 THEN run
  ELSE array_to_string([substr(run, i, 2) FOR i IN range(1, length(run))], ' ') END, ' ' ORDER BY pos) AS grams
FROM w GROUP BY p_partkey""",
)
def cjk_bigrams(t: Tables) -> DataFrame:
    han = F.translate(F.lower("p_name"), _LATIN, _HAN)
    return t.part.select("p_partkey", tx.cjk_bigrams(han).alias("grams"))


def length_ratio(query_text: str, texts: list[str]) -> list[float]:
    """A user scorer: shorter candidates first."""
    return [len(query_text) / (1.0 + len(text)) for text in texts]


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A user embedder: length and number of one letter."""
    return [[float(len(text)), float(text.count("e"))] for text in texts]


@query(
    "user_scorer", "R13,R24",
    f"""WITH {SCORED_SQL}, us AS (SELECT query_id, id, fused_score, length(qtext) / (1.0 + length(ctext)) AS s FROM sc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fused_score DESC, id) AS final_rank FROM us QUALIFY final_rank <= 10)
SELECT query_id, id, round(s, 6) AS rerank_score, final_rank::INT AS final_rank FROM ranked""",
)
def user_scorer(t: Tables) -> DataFrame:
    cand = candidates(t)
    scores = fusion.score_with(cand, "query_text", "candidate_text", length_ratio)
    return fusion.rerank_merge(cand, scores).select(
        "query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "final_rank"
    )


@query(
    "user_embedder", "R24",
    """SELECT doc_id AS id, length(text)::DOUBLE AS x0, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS x1 FROM documents""",
)
def user_embedder(t: Tables) -> DataFrame:
    return vectors.embed_with(t.wide("documents"), "doc_id", "text", letter_counts, 2).select(
        "id", F.col("v")[0].alias("x0"), F.col("v")[1].alias("x1")
    )
