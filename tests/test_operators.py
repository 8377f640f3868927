"""Operators against brute force on small fixtures, and the sinks and sources on real files."""

import json
import random

from pyspark.sql import functions as F

from veridoc.operators import audit as au
from veridoc.operators import blocks as bl
from veridoc.operators import chunking as ch
from veridoc.operators import conflicts as cf
from veridoc.operators import fusion, keyword, vectors
from veridoc.operators import matching as mt
from veridoc.sources import io
from veridoc.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- chunking --------------------------------------------------------------------------

BLOCK = "array<struct<block_type:string,text:string,page_number:int,section_title:string,row_start:int,row_end:int,sheet_name:string>>"


def chunks_of(spark, blocks, target, overlap):
    full = [(kind, text, page, section, row, row, sheet) for kind, text, page, section, row, sheet in blocks]
    df = spark.createDataFrame([(1, full)], f"id int, blocks {BLOCK}")
    return ch.chunk_documents(df, "id", F.col("blocks"), target, overlap).orderBy("chunk_index").collect()


def para(text, section="s", page=1):
    return ("paragraph", text, page, section, None, None)


def test_ranges_from_lengths():
    plain, keys = [ch.PLAIN] * 3, [7] * 3
    assert ch.pack_ranges([4, 4, 4], plain, keys, 9, 5) == [(0, 1, -1, -1), (1, 2, -1, -1)]
    assert ch.pack_ranges([4, 4, 4], plain, [7, 8, 8], 99, 50) == [(0, 0, -1, -1), (1, 2, -1, -1)]
    assert ch.pack_ranges([4, 6, 3], [ch.BARRIER, ch.PLAIN, ch.PLAIN], keys, 8, 7) == [(0, 0, -1, -1), (1, 1, -1, -1), (2, 2, -1, -1)]
    assert ch.pack_ranges([5, 4, 4], [ch.HEADER, ch.ROW, ch.ROW], keys, 12, 0) == [(0, 1, -1, -1), (2, 2, 0, 2)]
    assert ch.pack_ranges([50], [ch.PLAIN], [1], 10, 5) == [(0, 0, -1, -1)] and ch.pack_ranges([], [], [], 10, 5) == []


def test_chunk_texts_and_locators(spark):
    got = chunks_of(spark, [para("aaaa.bbbb!" * 1), para("cc"), ("heading", "head", 1, "t", None, None), para("x" * 6, "t")], 12, 5)
    assert [(r.text, r.locator.block_start, r.locator.block_end, r.locator.section_title) for r in got] == [
        ("aaaa.bbbb!", 0, 0, "s"), ("cc", 1, 1, "s"), ("head\nxxxxxx", 2, 3, "t"),
    ]


def test_rows_bring_their_header_once_and_stay_in_their_sheet(spark):
    def sheet(name, first):
        return [("table_header", "h | i", None, None, first, name)] + [("table_row", f"h: {i}", None, None, first + i, name) for i in (1, 2)]

    got = chunks_of(spark, sheet("S1", 1) + sheet("S2", 1), 12, 0)
    assert [(r.text, r.locator.sheet_name, r.locator.row_start, r.locator.row_end, r.locator.block_start) for r in got] == [
        ("h | i\nh: 1", "S1", 1, 2, 0), ("h | i\nh: 2", "S1", 1, 3, 0), ("h | i\nh: 1", "S2", 1, 2, 3), ("h | i\nh: 2", "S2", 1, 3, 3),
    ]


def test_documents_without_text_are_named(spark):
    docs = spark.createDataFrame([(1, [("paragraph", " \n", 1, None, None, None, None)]), (2, []), (3, [("paragraph", "a", 1, None, None, None, None)]), (4, None)], f"id int, blocks {BLOCK}")
    assert rows(ch.chunk_status(docs, "id", F.col("blocks")).select("doc_id", F.coalesce("failure", F.lit("")))) == [
        (1, "no_chunkable_text"), (2, "no_chunkable_text"), (3, ""), (4, "no_chunkable_text"),
    ]
    assert [r.doc_id for r in ch.chunk_documents(docs, "id", F.col("blocks")).collect()] == [3]


def test_cut_keeps_tokens_and_text(spark):
    table = [
        ("ab cd", 5, ["ab cd"]), ("one，two three", 8, ["one，", "two", "three"]), ("abcdef，ghij klm", 9, ["abcdef，", "ghij klm"]), ("aaaa bbbb cccc", 6, ["aaaa", "bbbb", "cccc"]),
        ("字" * 10, 4, ["字" * 4, "字" * 4, "字" * 2]), ("abcdef", 3, ["a", "b", "c", "def"]), ("a，" * 6, 5, ["a，a，", "a，a，", "a，a，"]),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(table)], "i int, t string")
    for i, (_, limit, want) in enumerate(table):
        assert got.filter(F.col("i") == i).select(ch.cut_pieces(F.col("t"), limit)).first()[0] == want
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 ，.-字") for _ in range(rng.randint(1, 60))).strip() for _ in range(200)]
    for r in spark.createDataFrame([(t,) for t in texts if t], "t string").select("t", ch.cut_pieces(F.col("t"), 12).alias("p")).collect():
        assert all(len(p) <= 12 for p in r.p) and "".join(r.p).replace(" ", "") == r.t.replace(" ", "")


def test_pages_and_skipped_levels(spark):
    text = "# A\np1\n### C\n\x06\nstill C\n## B\nend"
    got = bl.extract_blocks(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("block_index").collect()
    assert [(r.text, r.section_title, r.page_number) for r in got] == [
        ("A", "A", 1), ("p1", "A", 1), ("C", "A > C", 1), ("still C", "A > C", 2), ("B", "A > B", 2), ("end", "A > B", 2),
    ]


# --- retrieval ---------------------------------------------------------------------------

def test_match_plan_and_binds_tighter_than_or(spark):
    q = spark.createDataFrame([(1, "abc 一二三四五六七")], "id long, t string")
    plan = keyword.match_plan(q, "id", "t").where("mode = 'and'")
    got = rows(plan.groupBy("conj").agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("t")))
    assert got[0] == (0, "abc 一二") and [t for _c, t in got[1:]] == ["二三", "三四", "四五", "五六", "六七"]


def test_and_falls_back_to_or(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "blue")], "id long, text string")
    tokens = keyword.build_index(keyword.tokenised(docs, "id", ["text"]))
    q = spark.createDataFrame([(7, "red fox"), (8, "red blue"), (9, "  ")], "id long, t string")
    hits = keyword.keyword_matches(tokens, keyword.match_plan(q, "id", "t"))
    assert rows(hits.select("query_id", "id", "mode")) == [(7, 1, "and"), (8, 1, "or"), (8, 2, "or"), (8, 3, "or")]
    # restricted ids: the AND hit of query 7 may not be returned, its score statistics stay
    allowed = spark.createDataFrame([(2,), (3,)], "id long")
    part = keyword.keyword_matches(tokens, keyword.match_plan(q, "id", "t"), allowed)
    assert rows(part.select("query_id", "id", "mode")) == [(7, 2, "or"), (8, 2, "or"), (8, 3, "or")]
    whole = {(r.query_id, r.id): r.score for r in hits.collect()}
    assert all(r.score == whole[r.query_id, r.id] for r in part.collect() if (r.query_id, r.id) in whole)


def test_saved_index_equals_the_built_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red"), (3, "blue 狐狸 fox")], "id long, text string")
    tokens = keyword.tokenised(docs, "id", ["text"])
    built, saved = keyword.build_index(tokens), keyword.save_index(tokens, str(tmp_path / "index"))
    for name in ("postings", "terms", "totals"):
        a, b = getattr(built, name), getattr(saved, name)
        assert rows(a) == rows(b.select(*a.columns))


def test_rrf_order(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, id string, rank int")
    k = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, id string, rank int")
    got = fusion.rrf(d, k).orderBy("fused_rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"] and abs(got[0].fused_score - (1 / 61 + 1 / 62)) < 1e-12


def test_vector_grid_equals_single_block(spark):
    rng = random.Random(5)
    vec = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    v = spark.createDataFrame(vec, "id long, v array<double>").repartition(5)
    q = spark.createDataFrame([(i, x) for i, x in vec[:40]], "query_id long, v array<double>")
    a = rows(vectors.vector_top_k(q, v, 8, 5).select("query_id", "id", "rank"))
    b = rows(vectors.vector_top_k(q, v, 8, 5, block=7, cell_bytes=8 * 8 * 50).select("query_id", "id", "rank"))
    brute = []
    for qi, x in vec[:40]:
        near = sorted((round(sum((s - t) ** 2 for s, t in zip(x, y)), 9), i) for i, y in vec)[:5]
        brute += [(qi, i, r) for r, (_d, i) in enumerate(near, 1)]
    assert a == b == sorted(brute)


def test_ragged_and_infinite_vectors_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    v = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [1.0, 2.0, 3.0], 7), (3, [5.0], 7), (4, [inf, 0.0], 7), (5, [nan, 0.0], 7), (6, [None, 1.0], 7), (7, None, 7), (8, [0.0, 1.0], 8)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [inf, 0.0], 7), (3, [1.0], 7)], "query_id long, v array<double>, label int")
    assert rows(vectors.filtered_top_k(q, v, "label", 2).select("query_id", "id", "rank")) == [(1, 1, 1)]
    assert rows(vectors.vector_top_k(q, v, 2).select("query_id", "id", "rank")) == [(1, 1, 1), (1, 8, 2)]
    assert vectors.vector_top_k(q.limit(0), v, 2).count() == 0
    reasons = dict(map(tuple, vectors.check_vectors(v, 2, "id", "v").collect()))
    assert [i for i in sorted(reasons) if reasons[i] is None] == [1, 8]


def test_user_scorer_and_embedder(spark):
    df = spark.createDataFrame([(1, "a", "q", "xx", 1), (1, "b", "q", "x", 2)], "query_id long, id string, qt string, t string, fused_rank int")
    got = fusion.score_with(df, "qt", "t", lambda q, ts: [len(t) for t in ts])
    assert rows(got) == [(1, "a", 2.0), (1, "b", 1.0)]
    emb = vectors.embed_with(df, "id", "t", lambda ts: [[float(len(t)), 0.0] for t in ts], 2)
    assert rows(emb) == [("a", [2.0, 0.0]), ("b", [1.0, 0.0])]


# --- matching -----------------------------------------------------------------------------

def test_leaks_and_containment_match_brute_force(spark):
    rng = random.Random(11)
    secret = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(3)] + ["short"]
    docs = []
    for i in range(40):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 150)))
        if i % 3 == 0:
            s = secret[i % 4]
            cut = rng.randint(0, 20)
            text = text[: len(text) // 2] + s[cut : cut + rng.randint(15, 60)] + text[len(text) // 2 :]
        docs.append((i, text))
    docs.append((99, "xx" + secret[0] + "yy"))
    a = spark.createDataFrame(docs, "id long, text string")
    p = spark.createDataFrame([(s,) for s in secret], "text string")
    windows = {s.strip()[k : k + 20] for s in secret for k in range(len(s.strip()) - 19)}
    want = sorted((i, len({w for w in windows if w in t.strip()})) for i, t in docs)
    assert rows(mt.leaked_windows(a, p).select("id", "n_windows")) == want
    needles = [*secret[:3], secret[0][5:25], secret[1][3:33], "ab", "abc a", "c", "", "zz", docs[4][1][10:19]]
    n = spark.createDataFrame([(j, s) for j, s in enumerate(needles)], "needle_id long, needle string")
    assert (99, 0) in rows(mt.containing(a, n)) and (99, 3) in rows(mt.containing(a, n))
    assert rows(mt.containing(a, n)) == sorted((i, j) for i, t in docs for j, s in enumerate(needles) if s and s in t)
    assert mt.containing(a, n.limit(0)).count() == 0


# --- conflicts ---------------------------------------------------------------------------

def test_conflicts_match_sequential_rules(spark):
    rng = random.Random(2)
    obs = [(1, f"k{rng.randint(0, 3)}", f"v{rng.randint(0, 3)}", str(rng.randint(0, 2)), i // 2, i) for i in range(60)]
    df = spark.createDataFrame(obs, "group_id long, key string, version string, value string, idx long, pos long")
    first = {}
    for _g, k, v, x, i, p in sorted(obs, key=lambda o: (o[4], o[5])):
        first.setdefault((k, v), (x, i))
    members = {
        (k, v, i) for (k, v), (x, i) in first.items() if any(k == k2 and x != y and i != j for (k2, _), (y, j) in first.items())
    }
    assert {(r.key, r.version, r.idx) for r in cf.cross_version_participants(df).collect()} == members
    fields = {r.key: (r.n_versions, r.lo, r.hi) for r in cf.cross_version_fields(df).collect()}
    assert fields == {k: (len(i), min(i), max(i)) for k in {m[0] for m in members} for i in [[m[2] for m in members if m[0] == k]]}
    many = spark.createDataFrame([(1, "k", f"v{i}", str(i), i, 0) for i in range(65)], "group_id long, key string, version string, value string, idx long, pos long")
    assert rows(cf.cross_version_fields(many)) == [(1, "k", 65, 0, 64)]

    table = [
        # slot, body by position, positions that take part in a conflict
        ("one body", ["x", "x"], []), ("two", ["x", "y"], [0, 1]), ("late", ["x", "x", "y"], [0, 2]), ("back", ["x", "y", "x"], [0, 1, 2]),
        ("three", ["x", "y", "z"], [0, 1, 2]), ("twice", ["x", "y", "y"], [0, 1, 2]), ("x again", ["x", "x", "y", "x"], [0, 2, 3]), ("single", ["x"], []),
    ]
    lines = [(1, "d", a, "b", body, i, i) for a, bodies, _ in table for i, body in enumerate(bodies)]
    sl = spark.createDataFrame(lines, "group_id long, doc_id string, a string, b string, body string, idx long, pos long")
    assert {(r.a, r.idx) for r in cf.slot_hits(sl).collect()} == {(a, i) for a, _, hit in table for i in hit}


# --- audit ---------------------------------------------------------------------------------

def test_narrowest_cover_matches_brute_force(spark):
    rng = random.Random(4)
    chunks = [(f"c{i}", 1, i, s, s + rng.randint(0, 40)) for i in range(60) for s in [rng.randint(1, 80)]]
    targets = [(i, 1, s, s + rng.randint(0, 3)) for i in range(60) for s in [rng.randint(1, 100)]]
    got = dict(
        (r.target_id, r.chunk_id)
        for r in au.narrowest_cover(
            spark.createDataFrame(targets, "target_id long, doc_id long, start int, end int"),
            spark.createDataFrame(chunks, "chunk_id string, doc_id long, chunk_index int, start int, end int"),
        ).collect()
    )
    for t, _d, a, b in targets:
        fit = [((s, e) != (a, b), e - s, i, c) for c, _x, i, s, e in chunks if s <= a and e >= b]
        assert got[t] == (min(fit)[3] if fit else None)


def test_long_warnings_stay_as_rows(spark):
    items = spark.createDataFrame([(1, "r", 2, "C", str(i)) for i in range(5)] + [(2, "r", 2, "C", "x")], "set_id long, rule_set_id string, ordinal int, code string, item string")
    assert rows(au.warnings(items).select("set_id", "n_items", "first_item", "last_item")) == [(1, 5, "0", "4"), (2, 1, "x", "x")]
    many = spark.range(1001).select(F.lit(1).cast("long").alias("set_id"), F.lit("r").alias("rule_set_id"), F.lit(2).alias("ordinal"), F.lit("C").alias("code"), F.format_string("%04d", "id").alias("item"))
    assert rows(au.warnings(many).select("n_items", "first_item", "last_item")) == [(1001, "0000", "1000")]


def test_call_state_follows_the_sequence(spark):
    table = [
        # calls in order, configured, state
        ("", True, None), ("+", True, "VERIFIED"), ("-", True, "VERIFICATION_FAILED"), ("++", True, "VERIFIED"), ("+-", True, "VERIFICATION_FAILED"),
        ("-+", True, "VERIFICATION_FAILED"), ("-", False, "UNCONFIGURED"), ("--", False, "UNCONFIGURED"), ("+", False, "CONFIGURED_UNVERIFIED"),
        ("-+", False, "CONFIGURED_UNVERIFIED"), ("++", False, "VERIFIED"), ("-++", False, "VERIFICATION_FAILED"), ("+-", False, "VERIFICATION_FAILED"),
    ]
    data = [(p, s, c == "+", conf) for p, (calls, conf, _) in enumerate(table) for s, c in enumerate(calls)]
    got = jobs.call_audit(spark.createDataFrame(data, "provider long, seq long, succeeded boolean, configured boolean"))
    assert {r.provider: r.state for r in got.collect()} == {p: state for p, (calls, _, state) in enumerate(table) if calls}


# --- sources and sinks ------------------------------------------------------------------------

def test_manifest_and_files(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.pdf").write_bytes(b"one")
    (tmp_path / "corpus" / "b.docx").write_bytes(b"two")
    scan = io.scan_corpus(spark, str(tmp_path / "corpus"))
    files = scan.select(F.lit("v1").alias("dataset_version"), F.concat(F.lit("corpus/"), "file_name").alias("path"), "sha256")
    sha = {r.path: r.sha256 for r in files.collect()}
    docs = [(p, sha[p], p.rsplit(".", 1)[1], "c", "t", "1", "x") for p in sorted(sha)]
    base = spark.createDataFrame([("v1", True, "", docs)], io.MANIFEST_SCHEMA)
    good = base.withColumn("dataset_sha256", io.dataset_digest(F.col("documents")))
    assert rows(io.validate_manifest(good, files, "v1")) == [("v1", None)]
    assert rows(io.validate_manifest(base, files, "v1")) == [("v1", "dataset_sha256_mismatch")]
    assert rows(io.validate_manifest(good, files, "v2")) == [("v1", "dataset_version_mismatch")]
    extra = files.unionByName(files.limit(1).withColumn("path", F.lit("corpus/new.pdf")))
    assert rows(io.validate_manifest(good, extra, "v1")) == [("v1", "corpus_file_set_mismatch")]


def test_cases_replace_and_report(spark, tmp_path):
    ok = {
        "id": "c1", "category": "qa", "question": "q", "expected_source_paths": [], "should_refuse": False, "required_evidence_groups": [],
        "supporting_answer_facts": [], "supporting_source_paths": [], "supporting_locators": [],
    }
    bad = [
        ({"required_evidence_groups": [[]]}, "bad_required_evidence_groups"), ({"required_evidence_groups": [[{}], [1]]}, "bad_required_evidence_groups"),
        ({"required_evidence_groups": None}, "bad_required_evidence_groups"), ({"supporting_answer_facts": ["a", 1]}, "bad_supporting_answer_facts"),
        ({"supporting_source_paths": "a"}, "bad_supporting_source_paths"), ({"supporting_locators": [[]]}, "bad_supporting_locators"),
        ({"conflict_expected": None}, "bad_conflict_expected"), ({"conflict_expected": True, "required_evidence_groups": [[{"path": "a"}]]}, None),
    ]
    (tmp_path / "more.jsonl").write_text("\n".join(json.dumps({**ok, "id": f"m{i}", **b}) for i, (b, _) in enumerate(bad)), encoding="utf-8")
    assert [r.problem for r in io.read_cases(spark, str(tmp_path / "more.jsonl")).orderBy("line_no").collect()] == [p for _, p in bad]
    (tmp_path / "none.jsonl").write_text("\n \n")
    assert io.empty_case_set(io.read_cases(spark, str(tmp_path / "none.jsonl"))).first().empty
    lines = [json.dumps(ok), json.dumps(ok), "{", json.dumps({**ok, "id": "c2", "should_refuse": "no"}), json.dumps(ok) + "]"]
    (tmp_path / "cases.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = io.read_cases(spark, str(tmp_path / "cases.jsonl")).orderBy("line_no").collect()
    assert [r.problem for r in got] == [None, "duplicate_id", "not_json", "bad_should_refuse", "not_json"]

    cur = str(tmp_path / "v1")
    spark.createDataFrame([(1, "old"), (2, "keep")], "doc_id long, t string").write.parquet(cur)
    new = spark.createDataFrame([(1, "new"), (1, "new2")], "doc_id long, t string")
    assert rows(io.write_replace(cur, new, str(tmp_path / "v2"), "doc_id")) == [(1, "new"), (1, "new2"), (2, "keep")]
    assert rows(spark.read.parquet(cur)) == [(1, "old"), (2, "keep")]

    io.write_report(spark.createDataFrame([(1, 0.123456)], "id long, x double"), ["x"], str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first().value == '{"id":1,"x":0.1235}'


INGEST = "doc_id long, source_type string, source_key string, text string"


def test_ingest_replay_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "upload", "k", "# T\nalpha。beta"), (2, "upload", "k", "# T\nalpha。beta"), (3, "demo", "k", "gamma")], INGEST)
    root = str(tmp_path / "store")
    for batch, run in ((0, "a"), (0, "a"), (1, "a"), (0, "b")):
        jobs.ingest_batch(docs, batch, root, run)
    assert rows(jobs.committed(spark, root).select("doc_id", "source_type")) == [(1, "upload"), (3, "demo")]
    chunks = jobs.stored(spark, root, "chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 2
    assert {r.term for r in jobs.stored(spark, root, "postings").collect()} >= {"alpha", "beta", "gamma"}


def test_ingest_redelivery_and_two_texts_inside_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "upload", "k", "one")] * 2 + [(1, "upload", "k", "two"), (5, "upload", "k", "one")], INGEST)
    root = str(tmp_path / "store")
    jobs.ingest_batch(docs, 0, root, "a")
    assert jobs.committed(spark, root).count() == 2
    chunks = jobs.stored(spark, root, "chunks")
    assert rows(chunks.select("doc_id", "text")) == [(1, "one"), (1, "two")] and chunks.select("chunk_id").distinct().count() == 2


def test_a_new_checkpoint_keeps_earlier_documents(spark, tmp_path):
    from veridoc.session import Tables

    for k, rows_ in enumerate(([(1, "en", "s", "first text")], [(2, "en", "s", "second text")])):
        spark.createDataFrame(rows_, "doc_id long, lang string, source string, text string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
        stream = Tables(spark, str(tmp_path)).stream("documents").select("doc_id", F.lit("upload").alias("source_type"), F.col("source").alias("source_key"), "text")
        jobs.ingest_stream(stream, f"{tmp_path}/store", f"{tmp_path}/check{k}").awaitTermination()
    assert rows(jobs.committed(spark, f"{tmp_path}/store").select("doc_id")) == [(1,), (2,)]
    assert rows(jobs.stored(spark, f"{tmp_path}/store", "chunks").select("doc_id")) == [(1,), (2,)]


def test_results_do_not_depend_on_partitions(spark):
    recs = [(1, i, f"c{i % 4}", "passed" if i % 3 else "failed", "A" if i % 2 else None, i) for i in range(30)]
    df = spark.createDataFrame(recs, "set_id long, ordinal int, course_code string, status string, category string, n int").withColumn(
        "credits", F.col("n").cast("decimal(10,4)")
    )
    assert rows(au.resolve_status(df.repartition(1))) == rows(au.resolve_status(df.repartition(17)))


# --- schedule overlap ----------------------------------------------------------------------

def plain_overlaps(slots):
    found = set()
    for i, (s1, t1, c1, d1, u1, a1, b1) in enumerate(slots):
        for s2, t2, c2, d2, u2, a2, b2 in slots[i + 1:]:
            if (s1, t1, d1, u1) == (s2, t2, d2, u2) and c1 != c2:
                if (a1 < b2 and a2 < b1) if u1 == "clock" else (a1 <= b2 and a2 <= b1):
                    found.add((s1, min(c1, c2), max(c1, c2)))
    return found


def overlaps(spark, slots):
    return au.schedule_conflicts(spark.createDataFrame(slots, "set_id long, term string, course_code string, weekday string, unit string, start int, end int"))


def test_schedule_overlap_against_every_pair(spark):
    rng = random.Random(6)
    slots = []
    for unit, most, longest in (("clock", 1439, 90), ("clock", 60, 4), ("period", 14, 3), ("clock", 6039, 3000)):
        for _ in range(250):
            a = rng.randrange(most)
            slots.append((rng.randrange(4), "t", f"c{rng.randrange(9)}", rng.choice("一二"), unit, a, min(most, a + rng.choice([0, 1, rng.randrange(longest)]))))
    got = [tuple(r) for r in overlaps(spark, slots).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_overlaps(slots)
    for case in (
        [(1, "t", "a", "一", "clock", 5, 7), (1, "t", "a", "一", "clock", 7, 9), (1, "t", "b", "一", "clock", 7, 7)],  # an empty slot between two that touch
        [(1, "t", "a", "一", "clock", 5, 9), (1, "t", "b", "一", "clock", 7, 7)], [(1, "t", "a", "一", "clock", 5, 9), (1, "t", "b", "一", "clock", 5, 5)],
        [(1, "t", "a", "一", "period", 3, 3), (1, "t", "b", "一", "period", 3, 3)], [],
    ):
        assert {tuple(r) for r in overlaps(spark, case).collect()} == plain_overlaps(case)


def test_slots_of_a_crowded_hour_are_merged(spark):
    # 60 short slots a course in one hour, none of which meets a slot of another course
    slots = [(1, "t", f"c{k}", "一", "clock", 4 * i + k, 4 * i + k + 1) for i in range(15) for k in range(4)] * 20
    found = overlaps(spark, slots)
    assert found.count() == 0
    merged = au.merged_slots(spark.createDataFrame(slots, "set_id long, term string, course_code string, weekday string, unit string, start int, end int"))
    assert merged.count() == 60  # repeated slots are one
    run = [(1, "t", "a", "一", "clock", i, i + 2) for i in range(60)]
    one = au.merged_slots(spark.createDataFrame(run, "set_id long, term string, course_code string, weekday string, unit string, start int, end int")).collect()
    assert [(r.start, r.end) for r in one] == [(0, 61)]  # a chain of overlapping slots is one range


def test_conflict_members_are_all_there_in_order(spark):
    parts = spark.createDataFrame([(2, 9, "B"), (2, 3, "B"), (2, 3, "a"), (1, 5, "x")], "group_id int, idx long, key string")
    hits = spark.createDataFrame([(2, "p", "q", 3), (2, "p", "q", 1), (3, "r", "s", 7)], "group_id int, a string, b string, idx long")
    got = [tuple(r) for r in cf.conflict_members(parts, hits).collect()]
    assert got == [
        (1, "field", None, "cross_version", "x"), (1, "index", 5, None, None),
        (2, "field", None, "cross_version", "B"), (2, "field", None, "cross_version", "a"), (2, "field", None, "row_slot", "p|q"),
        (2, "index", 1, None, None), (2, "index", 3, None, None), (2, "index", 9, None, None),
        (3, "field", None, "row_slot", "r|s"), (3, "index", 7, None, None),
    ]
