"""Text expressions on small inline rows, CJK included."""

import pytest
from pyspark.sql import functions as F

from veridoc.functions import digest as dg
from veridoc.functions import naming, privacy
from veridoc.functions import text as tx
from veridoc.operators import audit as au
from veridoc.operators import conflicts as cf
from veridoc.operators import evaluation as ev


def one(spark, text, *exprs):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*exprs).first())


T = None


@pytest.fixture(autouse=True)
def column(spark):
    global T
    T = F.col("t")


def test_normal_forms(spark):
    raw = " été \r\n\r\n　b\t\tc\x07 \n"
    assert one(spark, raw, tx.norm_chunk(T), tx.norm_search(T)) == ("été\nb c", "été b c")
    assert one(spark, "Ａ：１ ／ Straße", tx.norm_match(T)) == ("a:1/strasse",)
    assert one(spark, None, tx.norm_block(T), tx.norm_match(T)) == ("", "")


def test_bigrams_and_terms(spark):
    assert one(spark, "学分认定 A 课", tx.cjk_bigrams(T)) == ("学分 分认 认定 课",)
    assert one(spark, "CS201课程_学分!", tx.query_terms(T)) == (["cs201课程", "学分"],)
    assert one(spark, "cs201课程表课程", tx.term_tokens(T)) == (["课程", "程表", "表课", "cs201"],)
    assert one(spark, "一二三四五六七", tx.term_is_loose(T)) == (True,)
    assert one(spark, "一二三四五六", tx.term_is_loose(T)) == (False,)
    assert one(spark, "Déjà-vu ÑU ok", tx.index_tokens(T)) == (["deja", "vu", "nu", "ok"],)


def test_sentences_and_labels(spark):
    assert one(spark, "甲。乙！ 丙；d.e", tx.split_sentences(T)) == (["甲。", "乙！", "丙；", "d.e"],)
    assert one(spark, "a: 1；b：2: 3；a: 9", au.labelled_map(T)) == ({"a": "1", "b": "2: 3"},)
    assert one(spark, "专业名称：软件 招生年份：2025", au.labelled_map(T)) == ({"专业名称": "软件", "招生年份": "2025"},)


def test_term_and_slot(spark):
    assert one(spark, "2026-2027 学年第一学期", tx.norm_term(T)) == ("2026-2027-1",)
    assert one(spark, "2026-2027-2", tx.norm_term(T)) == ("2026-2027-2",)
    assert one(spark, "next term", tx.norm_term(T)) == (None,)
    assert tuple(one(spark, "星期一第1-2节", tx.parse_slot(T))[0]) == ("一", "period", 1, 2)
    assert tuple(one(spark, "星期二 10:00-11:40", tx.parse_slot(T))[0]) == ("二", "clock", 600, 700)
    assert one(spark, "第1-2节", tx.parse_slot(T)) == (None,)


def test_metadata_and_cells(spark):
    meta = one(spark, "启明大学软件专业 2026-2027学年第二学期 QM-CS201", tx.derive_meta(T))[0]
    assert tuple(meta) == ("软件", "2026-2027", "2026-2027-2", "QM-CS201")
    row = one(spark, "x", tx.kv_row(F.array(F.lit("a"), F.lit("")), F.array(F.lit("1"), F.lit("2"), F.lit(""), F.lit("4"))))
    assert row == ("a: 1；第2列: 2；第4列: 4",)


def test_scrub_is_complete_and_idempotent(spark):
    raw = "姓名：张 三 学号: 20240001，电话 13812345678；邮箱 a.b@c.org 身份证号 110101199003074518 座机 010-12345678"
    clean = one(spark, raw, privacy.scrub(T))[0]
    for gone in ("张", "20240001", "13812345678", "a.b@c.org", "110101199003074518", "12345678"):
        assert gone not in clean
    assert "学号" in clean and one(spark, clean, privacy.scrub(T))[0] == clean
    # a value ends where the next field starts, also across academic fields
    assert one(spark, "姓名：李四 学分：4.0", privacy.scrub(T))[0] == "姓名：[REDACTED_NAME] 学分：4.0"


def test_names(spark):
    cases = {"": "empty", "a/b": "path_separator", "a／b": "separator_lookalike", "con.txt": "reserved_device_name", "a‮b": "bidi_control",
             "x" * 201: "too_long", "C:x": "drive_letter", "ok.pdf": None}
    for raw, want in cases.items():
        assert one(spark, raw, naming.name_violation(T)) == (want,), raw
    assert one(spark, "12-匿名A-课程", naming.record_set_name(T)) == ("课程 · 匿名A",)


def test_anchor_kinds(spark):
    norm = "于2026-09-01,10:30,qm-cs201学分4.0abc"
    assert one(spark, norm, tx.fact_anchors(T)) == (["2026-09-01", "10:30", "qm-cs201", "4.0abc"],)


def test_section_and_labels(spark):
    path = F.lit("根 > 章  >节")
    assert one(spark, "节", ev.section_match(T, path)) == (True,)
    assert one(spark, "根", ev.section_match(T, path)) == (False,)
    assert one(spark, "章 > 节", ev.section_match(T, path)) == (False,)
    assert one(spark, "Bad label!", tx.norm_label(T, "reason"), tx.norm_label(T, "digest")) == ("unknown", None)


def test_intents(spark):
    yes = cf.cross_version_intent(T), cf.row_slot_intent(T)
    assert one(spark, "两个版本 有何区别", *yes) == (True, False)
    assert one(spark, "2025.1 与 2026.1 是否一致", *yes) == (True, False)
    assert one(spark, "2026-2027 是否一致", *yes) == (False, False)
    assert one(spark, "课表 星期一第1-2节 有哪些课", *yes) == (False, True)


def test_field_pairs_keep_the_long_capture(spark):
    got = one(spark, "甲乙：1；丙丁：2\n文档版本：3", cf.pair_list(T))[0]
    assert [tuple(p) for p in got] == [("甲乙", "1；丙丁：2")]
    cut = one(spark, "甲乙：1；丙丁：2", cf.pair_list(T, True))[0]
    assert [tuple(p) for p in cut] == [("甲乙", "1")]


def test_stable_values(spark):
    import hashlib
    import json

    got = one(spark, "课", dg.stable_digest({"b": T, "a": F.lit(None).cast("string")}))[0]
    want = json.dumps({"a": None, "b": "课"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got == hashlib.sha256(want.encode()).hexdigest()
    score = one(spark, "问", dg.hash_score(T, F.lit("文")))[0]
    assert score == int.from_bytes(hashlib.sha256("问\0文".encode()).digest()[:8], "big") / float(2**64 - 1)


def test_credits(spark):
    df = spark.createDataFrame([("4.05",), ("NaN",), ("-1",), ("1000",), (None,), ("abc",), ("Infinity",)], "t string")
    got = [tuple(r.c) for r in df.select(au.to_credit(T).alias("c")).collect()]
    assert [e for _v, e in got] == [None, "not_a_number", "negative", "out_of_range", "not_a_number", "not_a_number", "not_finite"]
    assert str(df.limit(1).select(au.quantise(au.to_credit(T)["value"]).alias("q")).first().q) == "4.1"


def test_only_listed_reasons_pass(spark):
    got = spark.createDataFrame([(" not_json ",), ("NOT_JSON",), ("key=abc",), ("",), (None,)], "s string").select(tx.listed_label(F.col("s")).alias("l")).collect()
    assert [r.l for r in got] == ["not_json", "unknown", "unknown", None, None]


def test_cells_render_like_shortest_digits(spark):
    from pyspark.sql import types as T

    table = [(123456789.5, "123456789.5"), (0.0001, "0.0001"), (0.00001, "1e-05"), (1.25e-7, "1.25e-07"), (-12345678.25, "-12345678.25"), (3.0, "3"), (1e20, "100000000000000000000"), (0.1, "0.1"), (1e-3 / 3, "0.0003333333333333333"), (-0.5, "-0.5"), (4503599627370495.5, "4503599627370495.5"), (None, "")]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(table)], "i int, x double").orderBy("i").select(tx.cell_text(F.col("x"), T.DoubleType()).alias("s")).collect()
    assert [r.s for r in got] == [s for _, s in table]
