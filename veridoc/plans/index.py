"""Index-state, eligibility, source and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.digest import sha256, stable_digest
from veridoc.operators import eligibility as el
from veridoc.operators import indexstate as ix
from veridoc.plans.registry import query
from veridoc.session import Tables, checkpoint_root
from veridoc.sources import buckets, io
from veridoc.streaming import jobs, stages

FP = "fp-1"
CONFIG = {
    "parser": {"name": "markdown", "version": "1"},
    "normalization": {"version": "1"},
    "chunker": {"version": "1", "target_chars": 550, "overlap_chars": 100},
    "embedding": {"provider": "hash", "dimension": 64},
    "vector_schema": {"version": "1"},
    "keyword_schema": {"version": "1", "tokenizer": "unicode"},
}

META_SQL = """
meta AS (SELECT d.doc_id, CASE WHEN lang = 'en' THEN 'upload' ELSE 'demo' END AS source_type,
  source || ':' || d.doc_id AS source_key, source AS dataset_version, sha256(text) AS sha256, lang, source, n_chars,
  CASE WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'failed' ELSE 'queued' END AS status,
  coalesce(toxic = 1, false) AS deleted, coalesce(quality = 1, false) AS retrievable, toxic = 0 AS error_retryable,
  CASE WHEN lang = 'en' THEN NULL WHEN quality = 1 THEN 'active' ELSE 'candidate' END AS activation_state,
  CASE WHEN quality = 1 THEN 'completed' WHEN quality = 0 THEN 'chunked' ELSE 'none' END AS stage
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
ELIGIBLE_SQL = """
elig AS (SELECT * FROM meta WHERE NOT deleted AND status = 'ready' AND retrievable AND stage = 'completed'
  AND ((source_type = 'upload' AND activation_state IS NULL)
    OR (source_type = 'demo' AND activation_state = 'active' AND dataset_version = (SELECT min(source) FROM documents))))"""


def meta(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    upload = F.col("lang") == "en"
    no = F.lit(False)
    return d.select(
        "doc_id", F.when(upload, "upload").otherwise("demo").alias("source_type"),
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("source_key"),
        F.col("source").alias("dataset_version"), sha256(F.col("text")).alias("sha256"), "lang", "source", "n_chars",
        F.when(good, "ready").when(bad, "failed").otherwise("queued").alias("status"),
        F.coalesce(F.col("toxic") == 1, no).alias("deleted"), F.coalesce(good, no).alias("retrievable"),
        (F.col("toxic") == 0).alias("error_retryable"),
        F.when(upload, None).when(good, "active").otherwise("candidate").alias("activation_state"),
        F.when(good, "completed").when(bad, "chunked").otherwise("none").alias("stage"),
    )


def pointer(t: Tables) -> DataFrame:
    return t.documents.agg(F.min("source").alias("dataset_version")).withColumn("pipeline_fp", F.lit(FP))


def eligible_docs(t: Tables) -> DataFrame:
    m = meta(t)
    chunks = m.select("doc_id", F.col("doc_id").alias("chunk_id"))
    state = m.select("doc_id", "stage")
    return el.eligible(chunks, m.drop("stage"), state, pointer(t), FP)


# --- eligibility -------------------------------------------------------------

@query("eligible_chunks", "R10,R11", f"WITH {META_SQL}, {ELIGIBLE_SQL} SELECT doc_id AS chunk_id, source_type, dataset_version FROM elig")
def eligible_chunks(t: Tables) -> DataFrame:
    return eligible_docs(t).select("chunk_id", "source_type", "dataset_version")


@query(
    "eligible_filtered", "R9,R10",
    f"WITH {META_SQL}, {ELIGIBLE_SQL} SELECT doc_id AS chunk_id, lang AS doc_category FROM elig WHERE lang = 'en' AND source = 'src3'",
)
def eligible_filtered(t: Tables) -> DataFrame:
    rows = eligible_docs(t).withColumnsRenamed({"lang": "doc_category", "source": "major"})
    return rows.where(el.filters(doc_category="en", major="src3", semester=" ")).select("chunk_id", "doc_category")


@query(
    "hydrate_events", "R11",
    """SELECT event_id AS chunk_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract(props, '$.k')::INT END AS k
FROM events WHERE event_type <> 'view'""",
)
def hydrate_events(t: Tables) -> DataFrame:
    """Candidates are all events; view events are not eligible, error events carry broken JSON."""
    e = t.events.select(
        F.col("event_id").alias("chunk_id"), "event_type",
        F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props")).alias("citation"),
    )
    hits = t.events.select(F.col("event_id").alias("chunk_id"))
    return el.hydrate(hits, e.where("event_type <> 'view'"), {"citation": "k int"}).select(
        "chunk_id", "event_type", F.col("citation.k").alias("k")
    )


@query(
    "filter_options", "R20",
    f"""WITH {META_SQL}, {ELIGIBLE_SQL}, o AS (SELECT 'lang' AS field, lang AS value FROM elig UNION SELECT 'source', source FROM elig)
SELECT o.field, o.value, CASE o.value WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE o.value END AS label FROM o""",
)
def filter_options(t: Tables) -> DataFrame:
    labels = F.create_map(
        *[F.lit(x) for pair in (("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish")) for x in pair]
    )
    options = el.filter_options(eligible_docs(t), ["lang", "source"])
    return options.withColumn("label", F.coalesce(F.get(F.array(F.try_element_at(labels, F.col("value"))), F.lit(0)), "value"))


@query(
    "source_lookup", "R21",
    f"""WITH {META_SQL}, {ELIGIBLE_SQL},
refs AS (SELECT vec_id AS chunk_id FROM embeddings UNION SELECT item_id FROM benchmark)
SELECT doc_id AS chunk_id, doc_id, 'eligible' AS via FROM elig
UNION ALL SELECT doc_id, doc_id, 'referenced' FROM meta WHERE source_type = 'upload' AND status = 'queued' AND NOT deleted
 AND NOT retrievable AND doc_id IN (SELECT chunk_id FROM refs) AND doc_id NOT IN (SELECT doc_id FROM elig)""",
)
def source_lookup(t: Tables) -> DataFrame:
    m = meta(t)
    chunks = m.select("doc_id", F.col("doc_id").alias("chunk_id"))
    fallback = m.where("source_type = 'upload' AND status = 'queued' AND NOT deleted AND NOT retrievable")
    refs = [
        t.embeddings.select(F.col("vec_id").alias("chunk_id")),
        t.benchmark.select(F.col("item_id").alias("chunk_id")),
    ]
    return el.source_lookup(chunks, eligible_docs(t), chunks, fallback, refs)


# --- registration, replacement, deletion ---------------------------------------

@query(
    "register_dispositions", "S3",
    f"""WITH {META_SQL},
known AS (SELECT source_type, sha256, arg_max(doc_id, (n_chars, doc_id)) AS doc_id, arg_max(status, (n_chars, doc_id)) AS status,
   arg_max(coalesce(error_retryable, false), (n_chars, doc_id)) AS retry FROM meta WHERE status <> 'queued' AND NOT deleted GROUP BY ALL),
b AS (SELECT doc_id AS row_id, source_type, sha256, min(doc_id) OVER (PARTITION BY source_type, sha256) AS first_row FROM meta)
SELECT row_id, b.source_type, b.sha256, coalesce(k.doc_id, first_row) AS doc_id,
 CASE WHEN k.doc_id IS NULL THEN CASE WHEN row_id = first_row THEN 'created' ELSE 'attached' END
  WHEN k.status = 'ready' THEN 'existing_ready' WHEN k.status = 'failed' AND retry THEN
    CASE WHEN row_id = first_row THEN 'retry_started' ELSE 'attached' END WHEN k.status = 'failed' THEN 'rejected' ELSE 'attached' END AS disposition
FROM b LEFT JOIN known k ON k.source_type = b.source_type AND k.sha256 = b.sha256""",
)
def register_dispositions(t: Tables) -> DataFrame:
    m = meta(t)
    known = m.where("status <> 'queued'").withColumn("created_at", F.col("n_chars"))
    return ix.register(m.select(F.col("doc_id").alias("row_id"), "source_type", "sha256"), known)


@query(
    "replace_by_document", "S4",
    """WITH cur AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS block_index, 'line' AS kind FROM documents)
SELECT * FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT d.doc_id, 0, 'whole' FROM documents d JOIN labels USING (doc_id)""",
)
def replace_by_document(t: Tables) -> DataFrame:
    cur = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "line")).select(
        "doc_id", F.col("block_index").cast("bigint").alias("block_index"), F.lit("line").alias("kind")
    )
    new = t.documents.join(t.labels, "doc_id", "left_semi").select(
        "doc_id", F.lit(0).cast("bigint").alias("block_index"), F.lit("whole").alias("kind")
    )
    store = fresh_folder(t, "blocks")
    buckets.create_store(t.spark, store, {"blocks": (cur, "doc_id")}, 16)
    buckets.replace_documents(t.spark, store, [buckets.Change("blocks", new)])
    return buckets.read_table(t.spark, store, "blocks")


@query(
    "delete_documents", "S5",
    """WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'vectors' AS "table", count(*) AS kept FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'tombstones', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM gone)""",
)
def delete_documents(t: Tables) -> DataFrame:
    gone = t.labels.where("toxic = 1")
    left = ix.delete_documents(
        {"vectors": t.embeddings.select(F.col("vec_id").alias("doc_id")), "chunks": t.documents.select("doc_id")}, gone
    )
    marked = ix.tombstone(
        t.documents.select("doc_id", F.lit(None).cast("bigint").alias("deleted_at")), gone, F.col("doc_id")
    ).where("deleted_at IS NOT NULL")
    rows = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("kept")) for n, df in (*left.items(), ("tombstones", marked))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- fingerprints, stages --------------------------------------------------------

@query(
    "stage_fingerprints", "I1,P18",
    """SELECT DISTINCT source, sha256('{"name":"' || source || '","version":"1"}') AS parser_fingerprint,
sha256('{"overlap_chars":100,"source":"' || source || '","target_chars":550}') AS chunker_fingerprint FROM documents""",
)
def stage_fingerprints(t: Tables) -> DataFrame:
    """Per-source configuration digests."""
    return t.documents.select("source").distinct().select(
        "source",
        stable_digest({"version": F.lit("1"), "name": F.col("source")}).alias("parser_fingerprint"),
        stable_digest(
            {"target_chars": F.lit(550), "overlap_chars": F.lit(100), "source": F.col("source")}
        ).alias("chunker_fingerprint"),
    )


_PARTS = {
    name: "{" + ",".join(f'"{k}":' + (f'"{v}"' if isinstance(v, str) else str(v)) for k, v in sorted(part.items())) + "}" for name, part in CONFIG.items()
}
_PIPELINE = "{" + ",".join(f'"{name}":{_PARTS[name]}' for name in sorted(_PARTS)) + "}"


@query(
    "pipeline_fingerprints", "I1",
    "SELECT DISTINCT source, " + ", ".join(f"sha256('{text}') AS {name}" for name, text in _PARTS.items()) + f", sha256('{_PIPELINE}') AS pipeline FROM documents",
)
def pipeline_fingerprints(t: Tables) -> DataFrame:
    """All six configured parts and the pipeline over them, for every source that is prepared with them."""
    digests = ix.fingerprint_columns(CONFIG)
    return t.documents.select("source").distinct().select("source", *[c.alias(name) for name, c in digests.items()])


_RANK = "list_position(['none','validated','stored','parsed','chunked','vector_indexed','keyword_indexed','completed'], {}) - 1"
_NAME = "(['none','validated','stored','parsed','chunked','vector_indexed','keyword_indexed','completed'])[{} + 1]"


@query(
    "stage_invalidation", "I2",
    f"""WITH s AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'vector_indexed'
  WHEN '3-MEDIUM' THEN 'parsed' WHEN '5-LOW' THEN 'none' ELSE 'keyword_indexed' END AS stage, o_orderstatus AS st, month(o_orderdate) AS m FROM orders)
SELECT o_orderkey AS doc_id, {_NAME.format(f'''(CASE WHEN st = 'F' AND m <= 3 THEN least({_RANK.format('stage')}, 2)
 WHEN st = 'F' THEN least({_RANK.format('stage')}, 3) WHEN st = 'O' AND m <= 6 THEN least({_RANK.format('stage')}, 4)
 WHEN st = 'O' THEN least({_RANK.format('stage')}, 5) ELSE {_RANK.format('stage')} END)''')} AS effective_stage FROM s""",
)
def stage_invalidation(t: Tables) -> DataFrame:
    p, st, m = F.col("o_orderpriority"), F.col("o_orderstatus"), F.month("o_orderdate")
    stage = (
        F.when(p == "1-URGENT", "completed").when(p == "2-HIGH", "vector_indexed").when(p == "3-MEDIUM", "parsed")
        .when(p == "5-LOW", "none").otherwise("keyword_indexed")
    )
    same = {
        "parser": ~((st == "F") & (m <= 3)), "normalization": F.lit(True), "chunker": st != "F",
        "embedding": ~((st == "O") & (m <= 6)), "vector_schema": F.lit(True), "keyword_schema": st != "O",
    }
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), ix.effective_stage(stage, same).alias("effective_stage"))


def id_sets(t: Tables, group: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk, vector and keyword id sets; a document is one ``source``."""
    owner = t.documents.select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", group, "lang").alias("doc_id"))
    c = owner.select("doc_id", "chunk_id")
    v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), (F.col("label") < 5).alias("current")).join(owner, "chunk_id")
    k = t.labels.select(F.col("doc_id").alias("chunk_id"), (F.col("quality") == 1).alias("current")).join(owner, "chunk_id")
    return c, v, k


SETS_SQL = """
own AS (SELECT doc_id AS chunk_id, source || '/' || lang AS doc_id FROM documents),
per AS (SELECT own.doc_id, own.chunk_id, e.vec_id IS NOT NULL AS in_v, l.doc_id IS NOT NULL AS in_k, e.label < 5 AS v_cur
        FROM own LEFT JOIN embeddings e ON e.vec_id = own.chunk_id LEFT JOIN labels l ON l.doc_id = own.chunk_id),
facts AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (in_v) AS n_vectors, count(*) FILTER (in_k) AS n_keyword,
   bool_and(in_v) AS vector_set_ok, bool_and(in_k) AS keyword_set_ok, coalesce(bool_and(v_cur), true) AS vectors_current
   FROM per GROUP BY doc_id)"""


def recorded_state(t: Tables) -> DataFrame:
    c, v, k = id_sets(t)
    f = ix.set_facts(c, v, k)
    short = F.length("doc_id") < 7
    return f.select(
        "doc_id", F.lit("completed").alias("stage"), F.lit("a").alias("file_sha"),
        F.when(F.endswith("doc_id", F.lit("es")), "b").otherwise("a").alias("state_sha"),
        (F.col("n_chunks") + F.when(F.endswith("doc_id", F.lit("fr")), 1).otherwise(0)).alias("expected_chunks"),
        F.when(short, F.col("n_chunks")).otherwise(F.col("n_vectors")).alias("vector_count"),
        F.col("n_keyword").alias("keyword_count"), F.lit(True).alias("keyword_schema_ok"),
    )


@query(
    "verified_stage", "I3",
    f"""WITH {SETS_SQL}, s AS (SELECT *, CASE WHEN ends_with(doc_id, 'es') THEN 'b' ELSE 'a' END AS sha,
 n_chunks + CASE WHEN ends_with(doc_id, 'fr') THEN 1 ELSE 0 END AS expected,
 CASE WHEN length(doc_id) < 7 THEN n_chunks ELSE n_vectors END AS vc FROM facts)
SELECT doc_id, 'completed' AS stage, CASE WHEN sha <> 'a' THEN 'none' WHEN n_chunks <> expected THEN 'parsed'
 WHEN NOT vector_set_ok OR vc <> n_chunks OR NOT vectors_current THEN 'chunked'
 WHEN NOT keyword_set_ok OR n_keyword <> n_chunks THEN 'vector_indexed' ELSE 'completed' END AS verified_stage FROM s""",
)
def verified_stage(t: Tables) -> DataFrame:
    return ix.verified_stage(recorded_state(t), ix.set_facts(*id_sets(t)))


@query(
    "keyword_reconcile", "I4",
    """WITH e AS (SELECT doc_id AS chunk_id, lang FROM documents), r AS (SELECT vec_id AS chunk_id, label < 7 AS good FROM embeddings
 UNION ALL SELECT -1 - page_id, true FROM pages),
a AS (SELECT coalesce(lang, 'orphan') AS lang, CASE WHEN e.chunk_id IS NULL THEN 'delete' WHEN good IS NULL THEN 'insert' WHEN good THEN 'keep' ELSE 'refresh' END AS action
 FROM e FULL OUTER JOIN r ON e.chunk_id = r.chunk_id)
SELECT lang, count(*) FILTER (action IN ('insert', 'refresh')) AS inserted, count(*) FILTER (action IN ('delete', 'refresh')) AS deleted,
count(*) FILTER (action = 'keep') AS kept FROM a GROUP BY lang""",
)
def keyword_reconcile(t: Tables) -> DataFrame:
    e = t.documents.select(F.col("doc_id").alias("chunk_id"), F.lit(0).alias("doc_id"))
    r = t.embeddings.select(
        F.col("vec_id").alias("chunk_id"), F.lit(0).alias("doc_id"),
        F.when(F.col("label") < 7, FP).otherwise("old").alias("fingerprint"),
    ).unionByName(t.pages.select((F.lit(-1) - F.col("page_id")).alias("chunk_id"), F.lit(0).alias("doc_id"), F.lit(FP).alias("fingerprint")))
    lang = t.documents.select(F.col("doc_id").alias("chunk_id"), "lang")
    actions = ix.keyword_actions(e, r, F.lit(FP)).join(lang, "chunk_id", "left").withColumn("lang", F.coalesce("lang", F.lit("orphan")))
    return ix.action_counts(actions, ["lang"])


@query(
    "vector_pending", "I5",
    """SELECT coalesce(d.doc_id, e.vec_id) AS chunk_id, CASE WHEN d.doc_id IS NULL THEN 'drop' WHEN label < 5 THEN 'reuse' ELSE 'embed' END AS action
FROM (SELECT doc_id FROM documents WHERE lang <> 'fr') d FULL OUTER JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def vector_pending(t: Tables) -> DataFrame:
    e = t.documents.where("lang <> 'fr'").select(F.col("doc_id").alias("chunk_id"))
    s = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label")
    return ix.pending_vectors(e, s, F.col("label") < 5)


@query(
    "three_way", "I6",
    f"""WITH {SETS_SQL} SELECT doc_id, n_chunks, n_vectors, n_keyword, vector_set_ok AND keyword_set_ok
 AND n_chunks + CASE WHEN ends_with(doc_id, 'fr') THEN 1 ELSE 0 END = n_chunks
 AND CASE WHEN length(doc_id) < 7 THEN n_chunks ELSE n_vectors END = n_chunks AND n_keyword = n_chunks AS agree FROM facts""",
)
def three_way(t: Tables) -> DataFrame:
    return ix.three_way(ix.set_facts_by_digest(*id_sets(t)), recorded_state(t).drop("n_chunks"))


# --- activation -------------------------------------------------------------------

_ACT_SQL = f"""{META_SQL},
st AS (SELECT m.*, e.vec_id IS NOT NULL AS in_v, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS vc FROM meta m LEFT JOIN embeddings e ON e.vec_id = m.doc_id),
rs AS (SELECT source AS dataset_version, doc_id AS position, CASE WHEN lang = 'es' AND deleted THEN 'missing_document'
  WHEN status = 'failed' THEN 'failed_document' WHEN stage <> 'completed' THEN 'stage_incomplete'
  WHEN vc <> 1 THEN 'count_mismatch' END AS r FROM st),
act AS (SELECT dataset_version, count(*) AS n_documents, CASE WHEN bool_or(coalesce(r = 'missing_document', false)) THEN 'missing_document'
  ELSE arg_min(r, position) FILTER (r IS NOT NULL) END AS reason FROM rs GROUP BY dataset_version)"""


def activation_rows(t: Tables) -> DataFrame:
    m = meta(t)
    manifest = m.select("dataset_version", F.col("doc_id").alias("position"), "source_key")
    docs = m.where("NOT (lang = 'es' AND deleted)").select("doc_id", "source_key", "status")
    vec = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("vector_count"))
    one = F.lit(1)
    state = m.select("doc_id", "stage", one.alias("expected_chunks"), one.alias("keyword_count")).join(vec, "doc_id", "left")
    ids = m.select("doc_id", F.col("doc_id").alias("chunk_id"))
    facts = ix.set_facts(ids, t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("chunk_id")), ids)
    return ix.activation_check(manifest, docs, state, facts)


@query("activation_check", "I7", f"WITH {_ACT_SQL} SELECT dataset_version, n_documents, reason FROM act")
def activation_check(t: Tables) -> DataFrame:
    return activation_rows(t)


@query(
    "activation_switch", "I8",
    f"""WITH {META_SQL}, tgt AS (SELECT max(source) AS v FROM documents),
ok AS (SELECT count(*) > 0 AS allowed FROM meta, tgt WHERE dataset_version = v AND status = 'ready')
SELECT doc_id, CASE WHEN enter THEN 'ready' ELSE status END AS status, CASE WHEN enter THEN 'active' WHEN leave THEN 'inactive' ELSE activation_state END AS activation_state,
CASE WHEN enter THEN true WHEN leave THEN false ELSE retrievable END AS retrievable
FROM (SELECT meta.*, allowed AND source_type = 'demo' AND NOT deleted AND dataset_version = v AS enter,
  coalesce(allowed AND source_type = 'demo' AND NOT deleted AND dataset_version <> v AND activation_state = 'active', false) AS leave FROM meta, tgt, ok)""",
)
def activation_switch(t: Tables) -> DataFrame:
    m = meta(t).drop("stage")
    target = t.documents.agg(F.max("source").alias("v"))
    keys = m.where(F.col("dataset_version") == target.scalar()).select("source_key")
    ready = m.where((F.col("dataset_version") == target.scalar()) & (F.col("status") == "ready"))
    allowed = ready.agg((F.count(F.lit(1)) > 0).alias("ok")).scalar()
    return ix.activate(m, target.scalar(), allowed, keys).select("doc_id", "status", "activation_state", "retrievable")


def activation_pointers(t: Tables) -> DataFrame:
    """Per candidate version the pointer that activating it leaves; a version without a ready document is refused."""
    m = meta(t)
    ready = m.groupBy("dataset_version").agg(F.max(F.col("status") == "ready").alias("ok"))
    old = t.documents.agg(F.min("source").alias("dataset_version")).withColumns({"manifest_sha256": F.lit("old"), "pipeline_fp": F.lit("fp-0")})
    out = None
    for aim in ("min", "max"):
        target = m.agg(getattr(F, aim)("dataset_version").alias("dataset_version"))
        allowed = ready.join(target, "dataset_version").agg(F.max("ok")).scalar() & (F.lit(aim) == "max")
        row = target.select("dataset_version", sha256(F.col("dataset_version")).alias("manifest_sha256"), F.lit(FP).alias("pipeline_fp"))
        after = ix.active_pointer(old, row, allowed).withColumn("aim", F.lit(aim))
        out = after if out is None else out.unionByName(after)
    return out


@query(
    "activation_pointer", "I8",
    f"""WITH {META_SQL}, v AS (SELECT min(source) AS lo, max(source) AS hi FROM documents),
ok AS (SELECT coalesce(bool_or(status = 'ready'), false) AS allowed FROM meta, v WHERE dataset_version = hi)
SELECT 'min' AS aim, lo AS dataset_version, 'old' AS manifest_sha256, 'fp-0' AS pipeline_fp FROM v
UNION ALL SELECT 'max', CASE WHEN allowed THEN hi ELSE lo END, CASE WHEN allowed THEN sha256(hi) ELSE 'old' END, CASE WHEN allowed THEN '{FP}' ELSE 'fp-0' END FROM v, ok""",
)
def activation_pointer(t: Tables) -> DataFrame:
    return activation_pointers(t)


# --- listings ----------------------------------------------------------------------

@query(
    "doc_listing", "I9",
    """SELECT o_orderkey AS doc_id, o_orderdate AS created_at, coalesce(b.n, 0) AS block_count, coalesce(c.n, 0) AS chunk_count
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) b ON b.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) c ON c.l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P'""",
)
def doc_listing(t: Tables) -> DataFrame:
    docs = t.orders.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "P").alias("deleted")
    )
    items = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_returnflag")
    return ix.list_documents(docs, items, items.where("l_returnflag = 'A'")).select("doc_id", "created_at", "block_count", "chunk_count")


@query(
    "listing_totals", "I9",
    f"""WITH {META_SQL} SELECT count(*) AS total, count(*) FILTER (retrievable) AS retrievable,
count(*) FILTER (status NOT IN ('ready', 'failed')) AS processing, count(*) FILTER (status = 'failed') AS failed FROM meta WHERE NOT deleted""",
)
def listing_totals(t: Tables) -> DataFrame:
    return ix.listing_totals(meta(t))


@query(
    "doc_preview", "I10",
    """SELECT * FROM (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS block_index,
 l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS total, count(*) OVER (PARTITION BY l_orderkey) > 2 AS truncated FROM lineitem) WHERE block_index <= 2""",
)
def doc_preview(t: Tables) -> DataFrame:
    items = t.lineitem.withColumnRenamed("l_orderkey", "doc_id")
    return ix.preview(items, ["l_linenumber", "l_partkey", "l_suppkey"], 2).select(
        "doc_id", "block_index", "l_partkey", "total", "truncated"
    )


@query(
    "dataset_status", "I11",
    f"""WITH {META_SQL}, a AS (SELECT count(*) AS available, count(*) FILTER (status = 'ready' AND NOT deleted) AS ready,
 count(*) FILTER (status = 'failed' AND NOT deleted) AS failed FROM meta WHERE source_type = 'demo' AND source = 'src0')
SELECT available, ready, failed, available > 0 AND ready = available AND failed = 0 AS loaded,
CASE WHEN available > 0 AND ready = available AND failed = 0 THEN 'loaded' WHEN ready > 0 THEN 'partial' ELSE 'empty' END AS state FROM a""",
)
def dataset_status(t: Tables) -> DataFrame:
    m = meta(t)
    manifest = m.where("source_type = 'demo' AND source = 'src0'").select("source_key")
    p = pointer(t).withColumn("manifest_sha", F.lit("m"))
    return ix.dataset_status(manifest, m, p, "src0", "m", FP)


@query(
    "run_summary", "I12",
    """SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS imported, count(*) FILTER (event_type = 'click') AS resumed,
count(*) FILTER (event_type = 'signup') AS skipped, count(*) FILTER (event_type = 'error') AS failed,
count(*) FILTER (event_type = 'view' AND value > 60) AS outstanding,
CASE WHEN count(*) FILTER (event_type = 'view' AND value > 60) > 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status,
round_even(count(*) FILTER (event_type NOT IN ('view')) * 100.0 / count(*), 0)::INT AS progress_percent
FROM events WHERE NOT (event_type = 'view' AND value <= 60) GROUP BY user_id""",
)
def run_summary(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    result = (
        F.when(kind == "purchase", "imported").when(kind == "click", "resumed").when(kind == "signup", "skipped")
        .when(kind == "error", "failed")
    )
    items = t.events.where(~((kind == "view") & (F.col("value") <= 60))).select(F.col("user_id").alias("job_id"), result.alias("result"))
    return ix.run_summary(items)


_DIGEST = "sum(CAST('0x' || substr(sha256({}), 1, 15) AS UBIGINT)::HUGEINT)::VARCHAR"


@query(
    "table_snapshot_diff", "I13",
    f"""WITH b AS (SELECT 'labels' AS t, count(*) AS n, {_DIGEST.format("doc_id || chr(0) || quality || chr(0) || toxic")} AS d FROM labels
 UNION ALL SELECT 'documents', count(*), {_DIGEST.format("doc_id || chr(0) || lang")} FROM documents),
a AS (SELECT 'labels' AS t, count(*) AS n, {_DIGEST.format("doc_id || chr(0) || quality || chr(0) || 0")} AS d FROM labels
 UNION ALL SELECT 'documents', count(*), {_DIGEST.format("doc_id || chr(0) || lang")} FROM documents)
SELECT b.t AS "table", b.n AS rows_before, b.d AS digest_before, a.n AS rows_after, a.d AS digest_after, b.n <> a.n OR b.d <> a.d AS changed
FROM b JOIN a ON a.t = b.t""",
)
def table_snapshot_diff(t: Tables) -> DataFrame:
    """Before and after a run that resets every toxic flag."""
    docs = ix.table_snapshot(t.documents, "documents", ["doc_id", "lang"])
    cols = ["doc_id", "quality", "toxic"]
    before = ix.table_snapshot(t.labels, "labels", cols).unionByName(docs)
    after = ix.table_snapshot(t.labels.withColumn("toxic", F.lit(0)), "labels", cols).unionByName(docs)
    return ix.snapshot_diff(before, after)


# --- sources ------------------------------------------------------------------------

@query(
    "manifest_entries", "S1,S2",
    """WITH e AS (SELECT source AS v, doc_id, CASE WHEN lang = 'es' AND doc_id % 2 = 0 THEN 'other/' ELSE 'corpus/' END || doc_id || '.' ||
  CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'docx' ELSE 'xlsx' END AS path, sha256(text) AS sha, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
listed AS (SELECT * FROM e WHERE coalesce(toxic, 0) = 0), disk AS (SELECT * FROM e WHERE coalesce(quality, 1) = 1),
j AS (SELECT coalesce(l.v, d.v) AS dataset_version, coalesce(l.path, d.path) AS path, CASE WHEN l.path IS NULL THEN 'corpus_file_set_mismatch'
  WHEN NOT starts_with(l.path, 'corpus/') THEN 'path_outside_corpus' WHEN d.path IS NULL THEN 'manifest_file_missing'
  WHEN l.lang = 'de' AND l.quality = 1 THEN 'file_type_extension_mismatch' END AS reason
  FROM listed l FULL OUTER JOIN disk d ON l.v = d.v AND l.path = d.path)
SELECT dataset_version, count(*) AS n_entries, count(reason) AS n_bad,
arg_min(reason, (CASE WHEN reason = 'corpus_file_set_mismatch' THEN 1 ELSE 0 END, path)) FILTER (reason IS NOT NULL) AS reason FROM j GROUP BY dataset_version""",
)
def manifest_entries(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    ext = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "fr", "docx").otherwise("xlsx")
    folder = F.when((F.col("lang") == "es") & (F.col("doc_id") % 2 == 0), "other/").otherwise("corpus/")
    rows = d.select(
        F.col("source").alias("dataset_version"), F.concat(folder, F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        sha256(F.col("text")).alias("sha256"), "quality", "toxic",
        F.when((F.col("lang") == "de") & (F.col("quality") == 1), "pdf").otherwise(ext).alias("file_type"),
    )
    listed = rows.where(F.coalesce("toxic", F.lit(0)) == 0).drop("quality", "toxic")
    disk = rows.where(F.coalesce("quality", F.lit(1)) == 1)
    return io.first_reasons(io.entry_reasons(listed, disk))


_CASES_SQL = """WITH c AS (SELECT o_orderkey AS line_no, o_orderpriority AS category, o_orderstatus AS st, month(o_orderdate) AS m, o_orderkey % 8 AS k,
   'case' || CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey ELSE o_orderkey + 100000000 END AS id FROM orders),
p AS (SELECT line_no, CASE WHEN st = 'P' AND m = 1 THEN NULL ELSE id END AS id, CASE WHEN st = 'P' AND m = 1 THEN 'not_json' WHEN st = 'O' AND m = 2 THEN 'bad_question'
  WHEN st = 'F' AND m = 4 THEN 'bad_expected_source_paths'
  WHEN st = 'O' AND m = 5 AND k < 4 THEN 'bad_required_evidence_groups' WHEN st = 'O' AND m = 6 THEN 'bad_supporting_answer_facts' WHEN st = 'O' AND m = 7 THEN 'bad_supporting_locators'
  WHEN st = 'F' AND m = 3 THEN 'bad_should_refuse' WHEN st = 'O' AND m = 8 THEN 'bad_conflict_expected' END AS problem FROM c)"""


def case_line() -> Column:
    """A case in JSON from a row of ``orders``; some are broken."""
    st, m = F.col("o_orderstatus"), F.month("o_orderdate")
    case_id = F.concat(
        F.lit("case"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey")).otherwise(F.col("o_orderkey") + 100000000).cast("string"),
    )
    paths = F.when((st == "F") & (m == 4), F.lit('"one"')).otherwise(F.lit('["a.pdf","b.pdf"]'))
    refuse = F.when((st == "F") & (m == 3), F.lit('"yes"')).otherwise(F.lit("false"))
    question = F.when((st == "O") & (m == 2), F.lit(" ")).otherwise(F.lit("why?"))
    k, late = F.col("o_orderkey") % 8, st == "O"
    broken = F.when(k == 0, F.lit("[[]]")).when(k == 1, F.lit('"all"')).when(k == 2, F.lit("[[1]]")).otherwise(F.lit('[[{"path":"a"}],{"path":"b"}]'))
    groups = F.when(late & (m == 5) & (k < 4), broken).otherwise(F.lit('[[{"path":"a.pdf"},{"path":"b.pdf"}],[{"path":"c.pdf"}]]'))
    facts = F.when(late & (m == 6), F.lit('["fact"," "]')).otherwise(F.lit('["fact"]'))
    locators = F.when(late & (m == 7), F.lit('[{"path":"a"},"b"]')).otherwise(F.lit("[]"))
    conflict = F.when(late & (m == 8), F.lit('"no"')).otherwise(F.lit("true"))
    return F.concat(
        F.lit('{"id":"'), case_id, F.lit('","category":"'), F.col("o_orderpriority"), F.lit('","question":"'), question,
        F.lit('","expected_source_paths":'), paths, F.lit(',"required_evidence_groups":'), groups, F.lit(',"supporting_answer_facts":'), facts,
        F.lit(',"supporting_source_paths":[],"supporting_locators":'), locators, F.lit(',"conflict_expected":'), conflict, F.lit(',"should_refuse":'), refuse,
        F.when((st == "P") & (m == 1), F.lit("")).otherwise(F.lit("}")),
    )


@query(
    "case_lines", "S6,E1",
    f"""{_CASES_SQL}
SELECT line_no, id, CASE WHEN problem IS NULL AND line_no <> min(line_no) FILTER (problem IS NULL) OVER (PARTITION BY id) THEN 'duplicate_id' ELSE problem END AS problem FROM p""",
)
def case_lines(t: Tables) -> DataFrame:
    parsed = io.parse_cases(t.orders.select(F.col("o_orderkey").alias("line_no"), case_line().alias("value")))
    return parsed.select("line_no", F.when(F.col("problem") == "not_json", None).otherwise(F.col("id")).alias("id"), "problem")


ORDERS_PER_FILE = 5000


@query(
    "case_files", "S6",
    f"""{_CASES_SQL}, f AS (SELECT *, line_no // {ORDERS_PER_FILE} AS part, row_number() OVER (PARTITION BY line_no // {ORDERS_PER_FILE} ORDER BY line_no) AS nr FROM p),
o AS (SELECT *, part || '/' || lpad(nr::VARCHAR, 12, '0') AS place FROM f)
SELECT part, nr AS line_no, id, CASE WHEN problem IS NULL AND place <> min(place) FILTER (problem IS NULL) OVER (PARTITION BY id) THEN 'duplicate_id' ELSE problem END AS problem FROM o""",
)
def case_files(t: Tables) -> DataFrame:
    """Cases written to files and read back: problems are reported by the line of the file."""
    folder = fresh_folder(t, "cases")
    part = F.floor(F.col("o_orderkey") / ORDERS_PER_FILE)
    t.orders.select(part.alias("part"), "o_orderkey", case_line().alias("value")).repartition("part").sortWithinPartitions("part", "o_orderkey") \
        .drop("o_orderkey").write.partitionBy("part").text(folder)
    parsed = io.read_cases(t.spark, f"{folder}/*")
    return parsed.select(
        F.regexp_extract("file", r"part=(\d+)/", 1).cast("bigint").alias("part"), "line_no",
        F.when(F.col("problem") == "not_json", None).otherwise(F.col("id")).alias("id"), "problem",
    )


DOCUMENTS_PER_FILE = 100


def document_files(t: Tables) -> DataFrame:
    """Files of document digests, written and scanned: (part, file_name, path, size, sha256, file_type)."""
    folder = fresh_folder(t, "corpus")
    part = F.floor(F.col("doc_id") / DOCUMENTS_PER_FILE)
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    t.documents.select(part.alias("part"), "doc_id", line.alias("line")).repartition("part").sortWithinPartitions("part", "doc_id") \
        .drop("doc_id").write.partitionBy("part").option("extension", "pdf").csv(folder)
    return io.scan_corpus(t.spark, folder).withColumn("part", F.regexp_extract("path", r"part=(\d+)/", 1).cast("bigint"))


@query(
    "corpus_scan", "S1",
    f"""SELECT doc_id // {DOCUMENTS_PER_FILE} AS part, 'pdf' AS file_type, sum(length(doc_id || ':') + 33)::BIGINT AS size,
sha256(string_agg(doc_id || ':' || md5(coalesce(text, '')) || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY ALL""",
)
def corpus_scan(t: Tables) -> DataFrame:
    return document_files(t).select("part", "file_type", "size", "sha256")


VERSIONS = 6


@query(
    "manifest_check", "S1,S2",
    f"""WITH f AS (SELECT DISTINCT doc_id // {DOCUMENTS_PER_FILE} AS part FROM documents), v AS (SELECT part % {VERSIONS} AS v, count(*) AS n FROM f GROUP BY ALL)
SELECT 'v' || v AS dataset_version, CASE v WHEN 1 THEN 'checksum_mismatch' WHEN 2 THEN 'dataset_sha256_mismatch'
 WHEN 3 THEN CASE WHEN n = 1 THEN 'documents_missing' ELSE 'corpus_file_set_mismatch' END WHEN 4 THEN 'manifest_file_missing' WHEN 5 THEN 'dataset_version_mismatch' END AS reason FROM v""",
)
def manifest_check(t: Tables) -> DataFrame:
    """Six dataset versions over scanned files: one is right, the others are each wrong in one way."""
    v = F.col("part") % VERSIONS
    files = document_files(t).select(
        "part", v.alias("v"), F.concat(F.lit("v"), v.cast("string")).alias("dataset_version"),
        F.concat(F.lit("corpus/"), F.lpad(F.col("part").cast("string"), 12, "0"), F.lit(".pdf")).alias("path"), "sha256", "file_type",
    )
    last = files.groupBy("v").agg(F.max("part").alias("last"))
    edge = F.col("part") == F.col("last")
    listed = files.join(last, "v").where(~((F.col("v") == 3) & edge)).withColumn(
        "sha256", F.when((F.col("v") == 1) & edge, F.reverse("sha256")).otherwise(F.col("sha256"))
    )
    extra = listed.where((F.col("v") == 4) & edge).withColumn("path", F.concat(F.lit("corpus/x"), "path"))
    null = F.lit(None).cast("string")
    entry = F.struct(
        "path", "sha256", "file_type", null.alias("doc_category"), null.alias("title"), null.alias("version"), null.alias("effective_from")
    )
    # one manifest row holds the files of one dataset version
    gathered = listed.unionByName(extra).groupBy("v", "dataset_version").agg(F.array_sort(F.collect_list(entry)).alias("documents"))
    versions = files.select("v", "dataset_version").distinct()
    manifest = versions.join(gathered.drop("v"), "dataset_version", "left").select(
        "dataset_version", F.lit(True).alias("fictional"), "documents",
        F.when(F.col("v") == 2, "0").otherwise(io.dataset_digest(F.col("documents"))).alias("dataset_sha256"),
        F.when(F.col("v") == 5, "v0").otherwise(F.col("dataset_version")).alias("wanted"),
    )
    return io.validate_manifest(manifest, files.select("dataset_version", "path", "sha256"), F.col("wanted"))


@query(
    "report_rows", "S7",
    """SELECT '{"case_id":' || item_id || ',"n_chars":' || length(text) || ',"note":null,"question_sha":"' || sha256(text) || '"}' AS value FROM benchmark""",
)
def report_rows(t: Tables) -> DataFrame:
    cases = t.benchmark.select(
        F.col("item_id").alias("case_id"), F.length("text").alias("n_chars"), sha256(F.col("text")).alias("question_sha"),
        F.lit(None).cast("string").alias("note"),
    )
    return io.report_rows(cases, [])


# --- streaming -----------------------------------------------------------------------

def fresh_folder(t: Tables, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "ingest_stream", "W1,S3,C6",
    """SELECT min(doc_id) AS doc_id, source_type, sha FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'upload' ELSE 'demo' END AS source_type,
sha256(text) AS sha FROM documents) GROUP BY source_type, sha""",
)
def ingest_stream(t: Tables) -> DataFrame:
    """Drain the documents once, then again under a new checkpoint: the second run changes nothing."""
    root = drained(t)
    return jobs.committed(t.spark, root).select("doc_id", "source_type", F.col("sha256").alias("sha"))


def drained(t: Tables) -> str:
    root = fresh_folder(t, "ingest")
    for attempt in ("first", "again"):
        stream = t.stream("documents").select(
            "doc_id", F.when(F.col("lang") == "en", "upload").otherwise("demo").alias("source_type"),
            F.col("source").alias("source_key"), "text",
        )
        jobs.ingest_stream(stream, root, f"{root}/_{attempt}").awaitTermination()
    return root


@query(
    "ingest_chunks", "W1,C4,R4",
    """WITH d AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN 'upload' ELSE 'demo' END AS source_type, sha256(text) AS sha, length(trim(text)) > 0 AS ok FROM documents)
SELECT source_type, count(*) FILTER (ok)::BIGINT AS n_chunked, 0::BIGINT AS n_repeated, 0::BIGINT AS n_unindexed FROM d GROUP BY source_type""",
)
def ingest_chunks(t: Tables) -> DataFrame:
    """Per source: contents with chunks, chunk ids stored twice, and chunks with words but no posting."""
    root = drained(t)
    chunks = jobs.stored(t.spark, root, "chunks")
    known = jobs.committed(t.spark, root).select("doc_id", "source_type")
    indexed = jobs.stored(t.spark, root, "postings").select(F.col("id").alias("chunk_id")).distinct().withColumn("hit", F.lit(1))
    per_id = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max(F.col("text").rlike("[A-Za-z0-9]")).alias("wordy"))
    joined = per_id.join(known, "doc_id").join(indexed, "chunk_id", "left")
    return joined.groupBy("source_type").agg(
        F.count_distinct("doc_id").alias("n_chunked"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_if(F.col("wordy") & F.col("hit").isNull()).alias("n_unindexed"),
    )


@query(
    "ingest_stages", "W1,I2,I5",
    """WITH d AS (SELECT doc_id, lang, text, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS edited FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' THEN 'chunked' WHEN edited THEN 'none' ELSE 'vector_indexed' END AS start_stage,
  CASE WHEN lang = 'en' THEN 'embedding_changed' WHEN edited THEN 'content_changed' ELSE 'keyword_schema_changed' END AS reason,
  sha256(CASE WHEN edited THEN text || ' edited' ELSE text END) AS sha256 FROM d""",
)
def ingest_stages(t: Tables) -> DataFrame:
    """Three deliveries: all documents; some texts edited and a new keyword schema; English ones under a new embedding."""
    store = fresh_folder(t, "stages")
    docs = t.stream("documents").select("doc_id", "lang", F.lit("upload").alias("source_type"), F.col("doc_id").cast("string").alias("source_key"), "text")
    good = t.labels.where("quality = 1").select("doc_id").distinct().withColumn("edited", F.lit(True))
    second = docs.join(good, "doc_id", "left").withColumn("text", F.when(F.col("edited"), F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    words = CONFIG | {"keyword_schema": {"version": "2", "tokenizer": "unicode"}}
    vectors = words | {"embedding": {"provider": "hash", "dimension": 65}}
    for number, (rows, config) in enumerate(((docs, CONFIG), (second, words), (second.where("lang = 'en'"), vectors))):
        stages.ingest_staged(rows.select("source_type", "source_key", "text"), store, f"{store}/_checkpoint{number}", config, 16).awaitTermination()
    return buckets.read_table(t.spark, store, "state").select(F.col("source_key").cast("bigint").alias("doc_id"), "start_stage", "reason", "sha256")


CALLS_SQL = """
calls AS (SELECT user_id % 4 AS provider, event_id AS seq, event_type <> 'error' AS ok, user_id % 4 <> 3 AS configured FROM events),
cc AS (SELECT provider, count(*) AS calls, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, min(seq) FILTER (ok) AS first_ok, max(seq) AS last_seq, bool_or(configured) AS configured FROM calls GROUP BY provider),
audit AS (SELECT provider, calls, ok, failed, CASE WHEN configured THEN CASE WHEN failed > 0 THEN 'VERIFICATION_FAILED' WHEN ok > 0 THEN 'VERIFIED' ELSE 'CONFIGURED_UNVERIFIED' END
  WHEN first_ok IS NULL THEN 'UNCONFIGURED' WHEN last_seq = first_ok THEN 'CONFIGURED_UNVERIFIED' WHEN failed > 0 THEN 'VERIFICATION_FAILED' ELSE 'VERIFIED' END AS state FROM cc)"""


def call_log(events: DataFrame) -> DataFrame:
    provider = F.col("user_id") % 4
    return events.select(
        provider.alias("provider"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("succeeded"),
        (provider != 3).alias("configured"),
    )


@query("call_audit", "E32", f"WITH {CALLS_SQL} SELECT provider, calls, ok, failed, state FROM audit")
def call_audit(t: Tables) -> DataFrame:
    return jobs.call_audit(call_log(t.events))


@query("call_audit_by_user", "E32", f"WITH {CALLS_SQL.replace('user_id % 4 AS provider', 'user_id AS provider').replace('user_id % 4 <> 3', 'user_id < 5')} SELECT provider, calls, ok, failed, state FROM audit")
def call_audit_by_user(t: Tables) -> DataFrame:
    log = t.events.select(
        F.col("user_id").alias("provider"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("succeeded"),
        (F.col("user_id") < 5).alias("configured"),
    )
    return jobs.call_audit(log)


@query(
    "call_failures", "E32",
    """SELECT user_id % 4 AS provider, CASE event_id % 3 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'reranker_unavailable' ELSE 'unknown' END AS reason, count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY ALL""",
)
def call_failures(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, "TimeoutError").when(kind == 1, " reranker_unavailable ").when(F.col("event_id") % 2 == 0, F.col("props"))
    log = t.events.select((F.col("user_id") % 4).alias("provider"), (F.col("event_type") != "error").alias("succeeded"), raw.alias("reason"))
    return jobs.call_failures(log)


@query("call_audit_stream", "W2", f"WITH {CALLS_SQL} SELECT provider, calls, ok, failed, state FROM audit")
def call_audit_stream(t: Tables) -> DataFrame:
    root = fresh_folder(t, "audit")
    jobs.call_audit_stream(call_log(t.stream("events")), f"{root}/table", f"{root}/_checkpoint").awaitTermination()
    return jobs.latest_audit(t.spark, f"{root}/table").select("provider", "calls", "ok", "failed", "state")
