"""Document preparation queries: normalisation, blocks, grids, chunks, ids, privacy, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions import digest as dg
from veridoc.functions import naming, privacy
from veridoc.functions import text as tx
from veridoc.operators import blocks as bl
from veridoc.operators import chunking as ch
from veridoc.plans.registry import query
from veridoc.session import Tables

# --- P1-P4 ---------------------------------------------------------------
_NB = r"""trim(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[ \t\x{{3000}}]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), chr(10) || ' ')"""
_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@query(
    "block_normalise", "P1",
    f"SELECT doc_id, sha256({_NB.format('text')}) AS text_sha, length({_NB.format('text')})::INT AS n_chars FROM documents",
)
def block_normalise(t: Tables) -> DataFrame:
    norm = tx.norm_block(F.col("text"))
    return t.wide("documents").select("doc_id", dg.sha256(norm).alias("text_sha"), F.length(norm).alias("n_chars"))


@query(
    "chunk_normalise", "P2",
    f"""SELECT doc_id, sha256({_NB.format(f"regexp_replace(nfc_normalize(text), '{_CTRL}', '', 'g')")}) AS text_sha
FROM (SELECT doc_id, replace(text, ' ', chr(7) || ' ') AS text FROM documents)""",
)
def chunk_normalise(t: Tables) -> DataFrame:
    noisy = t.wide("documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("\x07 ")).alias("text"))
    return noisy.select("doc_id", dg.sha256(tx.norm_chunk(F.col("text"))).alias("text_sha"))


@query(
    "search_normalise", "P3",
    f"""SELECT doc_id, sha256(lower(trim(regexp_replace(regexp_replace(nfc_normalize(text), '{_CTRL}', '', 'g'),
'\\s+', ' ', 'g')))) AS text_sha FROM documents""",
)
def search_normalise(t: Tables) -> DataFrame:
    return t.wide("documents").select("doc_id", dg.sha256(tx.norm_search(F.col("text"))).alias("text_sha"))


@query(
    "match_normalise", "P4",
    """SELECT doc_id, sha256(regexp_replace(replace(lower(translate(text, '：，。；（）', ':,.;()')), 'ß', 'ss'),
'\\s+', '', 'g')) AS text_sha FROM documents""",
)
def match_normalise(t: Tables) -> DataFrame:
    return t.wide("documents").select("doc_id", dg.sha256(tx.norm_match(F.col("text"))).alias("text_sha"))


# --- P5, P6 ---------------------------------------------------------------

def markdown_docs(t: Tables) -> DataFrame:
    """Plain documents plus one structured text per customer (headings, a table, a skipped level)."""
    nl = F.lit("\n")
    sheet = t.wide("customer").select(
        (F.lit(10_000_000_000) + F.col("c_custkey")).alias("doc_id"),
        F.concat(
            F.lit("# "), "c_name", nl, F.lit("Segment "), "c_mktsegment", nl, F.lit("  nation  "),
            F.col("c_nationkey").cast("string"), nl, nl, F.lit("Second paragraph; with a stop!"), nl,
            F.lit("## Details"), nl, F.lit("| field | value |"), nl, F.lit("|---|:---:|"), nl,
            F.lit("| segment | "), "c_mktsegment", F.lit(" |"), nl, F.lit("| nation |  |"), nl,
            F.lit("after the table"), nl, F.lit("#### Notes"), nl, F.lit("note of "), "c_name", nl,
            F.lit("## Close"), nl, F.lit("| a | b | c |"), nl, F.lit("| x | "),
            F.col("c_nationkey").cast("string"), F.lit(" | y | extra |"),
        ).alias("text"),
    )
    return t.wide("documents").select("doc_id", "text").unionByName(sheet)


MARKDOWN_SQL = r"""
md AS (SELECT doc_id, text FROM documents UNION ALL
  SELECT 10000000000 + c_custkey, '# ' || c_name || chr(10) || 'Segment ' || c_mktsegment || chr(10) || '  nation  '
   || c_nationkey || chr(10) || chr(10) || 'Second paragraph; with a stop!' || chr(10) || '## Details' || chr(10)
   || '| field | value |' || chr(10) || '|---|:---:|' || chr(10) || '| segment | ' || c_mktsegment || ' |' || chr(10)
   || '| nation |  |' || chr(10) || 'after the table' || chr(10) || '#### Notes' || chr(10) || 'note of ' || c_name
   || chr(10) || '## Close' || chr(10) || '| a | b | c |' || chr(10) || '| x | ' || c_nationkey || ' | y | extra |'
  FROM customer),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
              unnest(range(len(string_split(text, chr(10))))) AS no FROM md),
k AS (SELECT doc_id, no, trim(raw) AS l,
        CASE WHEN trim(raw) = '' THEN 'b' WHEN regexp_matches(trim(raw), '^#{1,6}\s+.*$') THEN 'h'
             WHEN starts_with(trim(raw), '|') THEN 't' ELSE 'p' END AS kind FROM ln),
g AS (SELECT *, sum(CASE WHEN kind = 'h' OR kind IS DISTINCT FROM pk THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY no) AS grp
      FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY no) AS pk FROM k)),
para AS (SELECT doc_id, min(no) AS no, 'paragraph' AS block_type,
                trim(regexp_replace(string_agg(l, ' ' ORDER BY no), '[ \t]+', ' ', 'g')) AS text
         FROM g WHERE kind = 'p' GROUP BY doc_id, grp),
head AS (SELECT doc_id, no, 'heading' AS block_type,
                trim(regexp_replace(regexp_replace(l, '^#+\s+', ''), '[ \t]+', ' ', 'g')) AS text,
                length(regexp_extract(l, '^(#+)', 1)) AS level FROM g WHERE kind = 'h'),
tr AS (SELECT doc_id, grp, no, list_transform(string_split(trim(l, '|'), '|'), lambda c: trim(c)) AS cells
       FROM g WHERE kind = 't'),
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY no) AS rn FROM tr
       WHERE NOT (len(list_filter(cells, lambda c: c <> '')) > 0
         AND len(list_filter(cells, lambda c: c <> '' AND NOT regexp_full_match(c, ':?-{2,}:?'))) = 0)),
tb AS (SELECT a.doc_id, a.no, CASE WHEN a.rn = 1 THEN 'table_header' ELSE 'table_row' END AS block_type,
         CASE WHEN a.rn = 1 THEN array_to_string(a.cells, ' | ') ELSE
           array_to_string([CASE WHEN i <= len(h.cells) AND h.cells[i] <> '' THEN h.cells[i] ELSE '第' || i || '列' END
              || ': ' || a.cells[i] FOR i IN range(1, len(a.cells) + 1) IF a.cells[i] <> ''], '；') END AS text
       FROM tk a JOIN tk h ON a.doc_id = h.doc_id AND a.grp = h.grp AND h.rn = 1),
blk AS (SELECT doc_id, no, block_type, text FROM para WHERE text <> '' UNION ALL
        SELECT doc_id, no, block_type, text FROM head UNION ALL SELECT doc_id, no, block_type, text FROM tb),
bi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS block_index FROM blk)"""

PATH_SQL = """
hn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM head),
hd AS (SELECT *, i + least(0, min(level - i) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM hn),
anc AS (SELECT a.doc_id, a.no, a.depth, b.depth AS k, arg_max(b.text, b.i) AS title
        FROM hd a JOIN hd b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.depth <= a.depth
        GROUP BY a.doc_id, a.no, a.depth, b.depth),
path AS (SELECT doc_id, no, string_agg(title, ' > ' ORDER BY k) AS section_title, max(depth)::INT AS depth
         FROM anc GROUP BY doc_id, no)"""


@query(
    "block_extract", "P5",
    f"WITH {MARKDOWN_SQL} SELECT doc_id, block_index::INT AS block_index, block_type, text FROM bi",
)
def block_extract(t: Tables) -> DataFrame:
    return bl.extract_blocks(markdown_docs(t), "doc_id", "text").select(
        "doc_id", "block_index", "block_type", "text"
    )


@query(
    "heading_path", "P6",
    f"""WITH {MARKDOWN_SQL}, {PATH_SQL}
SELECT bi.doc_id, block_index::INT AS block_index, section_title, level::INT AS heading_level
FROM bi JOIN path USING (doc_id, no) JOIN head USING (doc_id, no)""",
)
def heading_path(t: Tables) -> DataFrame:
    return bl.extract_blocks(markdown_docs(t), "doc_id", "text").where("block_type = 'heading'").select(
        "doc_id", "block_index", "section_title", "heading_level"
    )


# --- P7-P10 ---------------------------------------------------------------

@query(
    "kv_rows", "P7,P10",
    """SELECT p_partkey, 'name: ' || p_name || '；brand: ' || p_brand
|| CASE WHEN p_type = 'ECONOMY' THEN '' ELSE '；第3列: ' || p_type END || '；size: ' || p_size
|| '；large: ' || CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'FALSE' END AS row_text FROM part""",
)
def kv_rows(t: Tables) -> DataFrame:
    p = t.part
    types = {f.name: f.dataType for f in p.schema}
    header = F.array(*[F.lit(h) for h in ("name", "brand", "", "size", "large")])
    large = F.col("p_size") > 25
    cells = F.array(
        *[tx.cell_text(F.col(c), types[c]) for c in ("p_name", "p_brand")],
        F.when(F.col("p_type") == "ECONOMY", "").otherwise(tx.cell_text(F.col("p_type"), types["p_type"])),
        tx.cell_text(F.col("p_size"), types["p_size"]),
        F.when(large, "TRUE").otherwise("FALSE"),
    )
    return p.select("p_partkey", tx.kv_row(header, cells).alias("row_text"))


@query(
    "cell_render", "P10",
    """SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR
ELSE p_retailprice::VARCHAR END AS price_text,
CASE WHEN p_size > 25 THEN 'TRUE' ELSE 'FALSE' END AS large_text,
CASE WHEN p_size > 40 THEN '' ELSE p_size::VARCHAR END AS size_text FROM part""",
)
def cell_render(t: Tables) -> DataFrame:
    p = t.part
    types = {f.name: f.dataType for f in p.schema}
    large = p.withColumn("large", F.col("p_size") > 25)
    return large.select(
        "p_partkey",
        tx.cell_text(F.col("p_retailprice"), types["p_retailprice"]).alias("price_text"),
        tx.cell_text(F.col("large"), large.schema["large"].dataType).alias("large_text"),
        tx.cell_text(F.when(F.col("p_size") <= 40, F.col("p_size")), types["p_size"]).alias("size_text"),
    )


def order_cells(t: Tables) -> DataFrame:
    """One sheet per order: caption row, header row (one name missing), one row per line item."""
    top = t.orders.select(
        F.col("o_orderkey").alias("sheet"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.col("o_orderpriority").alias("value")),
                F.struct(F.lit(2).alias("row"), F.lit(1).alias("col"), F.lit("part").alias("value")),
                F.struct(F.lit(2).alias("row"), F.lit(2).alias("col"), F.lit("flag").alias("value")),
                F.struct(F.lit(2).alias("row"), F.lit(3).alias("col"), F.lit("").alias("value")),
            )
        ).alias("c"),
    ).select("sheet", "c.*")
    items = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s")
    )
    body = items.select(
        F.col("l_orderkey").alias("sheet"),
        F.explode(
            F.array(
                F.struct((F.col("l_linenumber") + 2).alias("row"), F.lit(1).alias("col"), F.col("p").cast("string").alias("value")),
                F.struct((F.col("l_linenumber") + 2).alias("row"), F.lit(2).alias("col"), F.when(F.col("f") != "A", F.col("f")).alias("value")),
                F.struct((F.col("l_linenumber") + 2).alias("row"), F.lit(3).alias("col"), F.col("s").alias("value")),
            )
        ).alias("c"),
    ).select("sheet", "c.*")
    return top.unionByName(body)


@query(
    "grid_header", "P7,P8",
    """SELECT o_orderkey AS sheet, 1 AS row_start, 1 AS row_end, 'caption' AS block_type, o_orderpriority AS text FROM orders
UNION ALL SELECT o_orderkey, 2, 2, 'table_header', 'part | flag | 第3列' FROM orders
UNION ALL SELECT l_orderkey, l_linenumber + 2, l_linenumber + 2, 'table_row', 'part: ' || min(l_partkey)
 || CASE WHEN min(l_returnflag) <> 'A' THEN '；flag: ' || min(l_returnflag) ELSE '' END || '；第3列: ' || min(l_linestatus)
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_linenumber""",
)
def grid_header(t: Tables) -> DataFrame:
    return bl.grid_to_blocks(order_cells(t))


@query(
    "merged_fill", "P9",
    """WITH r AS (SELECT o_custkey AS sheet, min(o_orderkey) AS r1 FROM orders GROUP BY o_custkey)
SELECT o_custkey AS sheet, o_orderkey AS row, 1 AS col,
       first_.o_orderpriority AS value
FROM orders JOIN r ON sheet = o_custkey JOIN (SELECT o_orderkey AS k, o_orderpriority FROM orders) first_ ON k = r1
UNION ALL SELECT o_custkey, o_orderkey, 2, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END FROM orders""",
)
def merged_fill(t: Tables) -> DataFrame:
    """Column 1 is written only in the first row of a customer's sheet and merged downwards."""
    o = t.orders
    ranges = o.groupBy(F.col("o_custkey").alias("sheet")).agg(
        F.min("o_orderkey").alias("r1"), F.max("o_orderkey").alias("r2")
    )
    ranges = ranges.withColumn("c1", F.lit(1)).withColumn("c2", F.lit(1))
    first = ranges.select(F.col("r1").alias("o_orderkey"), F.lit(True).alias("is_first"))
    cells = o.join(first, "o_orderkey", "left").select(
        F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("row"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("col"), F.when(F.col("is_first"), F.col("o_orderpriority")).alias("value")),
                F.struct(F.lit(2).alias("col"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("value")),
            )
        ).alias("c"),
    ).select("sheet", "row", "c.*")
    return bl.fill_merged(cells, ranges)


# --- P11, P12, P16-P18 -----------------------------------------------------

@query(
    "title_meta", "P11",
    """SELECT o_orderkey, o_orderpriority AS major,
strftime(o_orderdate, '%Y') || '-' || (year(o_orderdate) + 1) AS academic_year,
strftime(o_orderdate, '%Y') || '-' || (year(o_orderdate) + 1) || '-' || CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '2' END AS semester,
CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'QM-CS' || printf('%03d', month(o_orderdate)) END AS course_code
FROM orders""",
)
def title_meta(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    title = F.concat(
        F.lit("启明大学"), "o_orderpriority", F.lit("专业 "), year.cast("string"), F.lit("-"), (year + 1).cast("string"),
        F.lit("学年第"), F.when(F.col("o_orderstatus") == "F", "一").otherwise("二"), F.lit("学期"),
    )
    name = F.when(F.col("o_orderstatus") == "P", "plan").otherwise(
        F.format_string("QM-CS%03d plan", F.month("o_orderdate"))
    )
    meta = tx.derive_meta(title, name)
    return t.orders.select("o_orderkey", meta.alias("m")).select("o_orderkey", "m.*")


@query(
    "label_pairs", "P12",
    """SELECT o_orderkey, 'priority' AS label, o_orderpriority AS value FROM orders
UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 'at', strftime(o_orderdate, '%H:%M') FROM orders""",
)
def label_pairs(t: Tables) -> DataFrame:
    text = F.concat(
        F.lit("priority："), "o_orderpriority", F.lit("；status: "), "o_orderstatus", F.lit("；at："),
        F.date_format("o_orderdate", "HH:mm"), F.lit("；status: repeated"),
    )
    pairs = tx.first_wins_map(tx.segment_pairs(text))
    return t.orders.select("o_orderkey", F.explode(pairs).alias("label", "value"))


@query(
    "name_violations", "P15",
    """WITH n AS (SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN p_name || '.' WHEN p_size > 40 THEN ' ' || p_name
  WHEN p_size > 38 THEN 'con.' || p_name WHEN p_size > 36 THEN 'C:' || p_name WHEN p_size > 34 THEN p_name || '..x'
  WHEN p_size > 32 THEN '' ELSE p_name END AS name FROM part UNION ALL SELECT -1 - page_id, url FROM pages)
SELECT id, CASE WHEN name IN ('', '.', '..') THEN 'empty' WHEN length(name) > 200 THEN 'too_long'
 WHEN name <> trim(name) THEN 'surrounding_whitespace' WHEN regexp_matches(name, '[/\\\\]') THEN 'path_separator'
 WHEN contains(name, '..') THEN 'parent_reference' WHEN regexp_matches(name, '^[A-Za-z]:') THEN 'drive_letter'
 WHEN ends_with(name, '.') THEN 'trailing_space_or_dot'
 WHEN lower(string_split(name, '.')[1]) IN ('con', 'prn', 'aux', 'nul') THEN 'reserved_device_name' END AS reason FROM n""",
)
def name_violations(t: Tables) -> DataFrame:
    size = F.col("p_size")
    name = (
        F.when(size > 45, F.concat("p_name", F.lit("."))).when(size > 40, F.concat(F.lit(" "), "p_name"))
        .when(size > 38, F.concat(F.lit("con."), "p_name")).when(size > 36, F.concat(F.lit("C:"), "p_name"))
        .when(size > 34, F.concat("p_name", F.lit("..x"))).when(size > 32, F.lit("")).otherwise(F.col("p_name"))
    )
    names = t.part.select(F.col("p_partkey").alias("id"), name.alias("name")).unionByName(
        t.pages.select((F.lit(-1) - F.col("page_id")).alias("id"), F.col("url").alias("name"))
    )
    return names.select("id", naming.name_violation(F.col("name")).alias("reason"))


@query(
    "display_names", "P16",
    """SELECT s_suppkey, split_part(s_name, '#', 2) || ' · ' || split_part(s_name, '#', 1) AS display_name FROM supplier""",
)
def display_names(t: Tables) -> DataFrame:
    stem = F.concat(F.lit("07-"), F.replace("s_name", F.lit("#"), F.lit("-")))
    return t.supplier.select("s_suppkey", naming.record_set_name(stem).alias("display_name"))


@query(
    "locator_kinds", "P17",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ['page_number', 'section_title'] WHEN 'O' THEN ['section_title']
ELSE ['sheet_name', 'row_start', 'row_end'] END AS locator_types,
CASE o_orderpriority WHEN '1-URGENT' THEN 'ready' WHEN '2-HIGH' THEN 'parsing' WHEN '3-MEDIUM' THEN 'storing' ELSE 'queued' END
AS public_status FROM orders""",
)
def locator_kinds(t: Tables) -> DataFrame:
    from veridoc.operators.indexstate import locator_types, next_status

    file_type = F.when(F.col("o_orderstatus") == "F", "pdf").when(F.col("o_orderstatus") == "O", "docx").otherwise("xlsx")
    stage = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "completed")
        .when(F.col("o_orderpriority") == "2-HIGH", "stored")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "validated").otherwise("chunked")
    )
    return t.orders.select(
        "o_orderkey", locator_types(file_type, F.lit(1)).alias("locator_types"), next_status(stage).alias("public_status")
    )


@query(
    "stable_digests", "P18",
    """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"missing":null,"name":"' || n_name || '","region":' || n_regionkey || '}')
AS digest FROM nation""",
)
def stable_digests(t: Tables) -> DataFrame:
    return t.nation.select(
        "n_nationkey",
        dg.stable_digest(
            {"name": F.col("n_name"), "key": F.col("n_nationkey"), "region": F.col("n_regionkey"),
             "missing": F.lit(None).cast("string")}
        ).alias("digest"),
    )


# --- P13, P14 ---------------------------------------------------------------

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_RUNS = "regexp_extract_all(text, '[0-9]+')"


@query(
    "pii_scrub_email", "P13",
    f"""SELECT doc_id, sha256(regexp_replace(text, '{_EMAIL}', '[REDACTED_EMAIL]', 'g')) AS text_sha,
len(regexp_extract_all(text, '{_EMAIL}'))::BIGINT AS n_emails FROM documents""",
)
def pii_scrub_email(t: Tables) -> DataFrame:
    return t.wide("documents").select(
        "doc_id", dg.sha256(privacy.scrub(F.col("text"), ("email",))).alias("text_sha"),
        F.regexp_count("text", F.lit(privacy.EMAIL)).cast("bigint").alias("n_emails"),
    )


@query("pii_scrub_full", "P13")
def pii_scrub_full(t: Tables) -> DataFrame:
    clean = privacy.scrub(F.col("text"))
    docs = t.wide("documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        t.conversations.select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    )
    return docs.select("kind", "id", clean.alias("text"), (clean != F.col("text")).alias("changed"))


@query(
    "pii_scan", "P14",
    f"""SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::BIGINT AS email,
len(list_filter({_RUNS}, lambda r: regexp_full_match(r, '1[3-9][0-9]{{9}}')))::BIGINT AS mobile,
len(regexp_extract_all(text, '(?:^|[^0-9])0[0-9]{{2,3}}-[0-9]{{7,8}}(?:[^0-9]|$)'))::BIGINT AS landline,
len(regexp_extract_all(text, '(?:^|[^0-9])[0-9]{{17}}[0-9Xx](?:[^0-9]|$)'))::BIGINT AS id_number,
len(regexp_extract_all(text, '(?i)https?://|www\\.'))::BIGINT AS url,
len(regexp_extract_all(text, '(?i)[\\w\\p{{L}}-]+\\.(?:com|cn|edu|org|net|gov)(?:[^\\w\\p{{L}}]|$)'))::BIGINT AS domain,
len(regexp_extract_all(text, '[A-Za-z]:\\\\'))::BIGINT AS absolute_path FROM documents""",
)
def pii_scan(t: Tables) -> DataFrame:
    return t.wide("documents").select("doc_id", *privacy.scan_counts(F.col("text")))


@query(
    "forbidden_keywords", "P14",
    """WITH k AS (SELECT n_name AS keyword FROM nation UNION ALL SELECT unnest(['token', 'license', 'secret']))
SELECT lang, count(*) AS docs, count(*) FILTER (contains(lower(text), 'token')) AS token,
count(*) FILTER (contains(lower(text), 'license')) AS license, count(*) FILTER (contains(lower(text), 'secret')) AS secret
FROM documents GROUP BY lang""",
)
def forbidden_keywords(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.wide("documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.count_if(F.contains(low, F.lit(w))).alias(w) for w in ("token", "license", "secret")],
    )


# --- C1-C7 ---------------------------------------------------------------

@query(
    "sentence_split", "C1",
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(
  trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), chr(10) || ' '),
  '([!?;.])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, (i - 1)::INT AS sentence_no, a[i] AS sentence FROM s, unnest(range(1, len(a) + 1)) r(i)""",
)
def sentence_split(t: Tables) -> DataFrame:
    pieces = tx.split_sentences(tx.norm_block(F.col("text")), "!?;.")
    return t.wide("documents").select("doc_id", F.posexplode(pieces).alias("sentence_no", "sentence"))


def chunked(t: Tables) -> DataFrame:
    docs = markdown_docs(t).withColumn("text", tx.nfc(F.col("text")))
    return ch.chunk_documents(docs, "doc_id", bl.block_array(F.col("text")))


@query("chunk_pack", "C2,C3,C4,C5")
def chunk_pack(t: Tables) -> DataFrame:
    return chunked(t).select("doc_id", "chunk_index", "text", "locator.*")


@query(
    "chunk_coverage", "C3,C4,P5",
    f"""WITH {MARKDOWN_SQL} SELECT doc_id, count(*)::BIGINT AS n_blocks, max(block_index)::INT AS last_block FROM bi GROUP BY doc_id""",
)
def chunk_coverage(t: Tables) -> DataFrame:
    """Every block of every document is inside the block range of some chunk."""
    covered = chunked(t).select(
        "doc_id", F.explode(F.sequence("locator.block_start", "locator.block_end")).alias("b")
    ).distinct()
    return covered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("b").alias("last_block"))


@query(
    "chunk_status", "C4",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no_chunkable_text' END AS failure FROM documents""",
)
def chunk_status(t: Tables) -> DataFrame:
    """Documents that have nothing to chunk are named; every seventh is blanked."""
    blanked = t.wide("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, " \n ").otherwise(F.col("text")).alias("text"))
    return ch.chunk_status(blanked, "doc_id", bl.block_array(F.col("text"))).select("doc_id", "failure")


_CHUNK_ID_SQL = """
WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no,
                  source, sha256(text) AS sha FROM documents)
SELECT doc_id, no::INT AS chunk_index, sha256(sha256('upload' || chr(31) || source || chr(31) || sha) || chr(31)
 || '{"block_end":' || no || ',"block_start":' || no || ',"page_number":1,"row_end":null,"row_start":null,"section_title":null,"sheet_name":null}'
 || chr(31) || no || chr(31) || '1' || chr(31) || '1') AS chunk_id FROM c"""


@query("chunk_ids", "C6,P18", _CHUNK_ID_SQL)
def chunk_ids(t: Tables) -> DataFrame:
    none = F.lit(None)
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")).select(
        "doc_id", "chunk_index",
        F.struct(
            F.col("chunk_index").alias("block_end"), F.col("chunk_index").alias("block_start"),
            F.lit(1).alias("page_number"), none.cast("int").alias("row_end"), none.cast("int").alias("row_start"),
            none.cast("string").alias("section_title"), none.cast("string").alias("sheet_name"),
        ).alias("locator"),
    )
    docs = t.documents.select(
        "doc_id", F.lit("upload").alias("source_type"), F.col("source").alias("source_key"),
        dg.sha256(F.col("text")).alias("file_sha"),
    )
    return ch.with_chunk_ids(lines, docs).select("doc_id", "chunk_index", "chunk_id")


@query(
    "chunk_citations", "C7,P11",
    """WITH l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(len(string_split(text, chr(10))))) AS no FROM documents)
SELECT doc_id, no::INT AS chunk_index, lang AS doc_category, source AS file_name, upper(lang) AS major FROM l""",
)
def chunk_citations(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    docs = t.documents.select(
        "doc_id", F.col("lang").alias("doc_category"), F.col("source").alias("file_name"),
        F.concat(F.lit("启明大学"), F.upper("lang"), F.lit("专业培养方案")).alias("title"),
    )
    cited = ch.with_citation(lines, docs, ["doc_category", "file_name"], "title", "file_name")
    return cited.select(
        "doc_id", "chunk_index", "citation.doc_category", "citation.file_name", "citation.major"
    )
