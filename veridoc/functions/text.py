"""Text expressions: normalisation, tokens, sentences, labels, anchors.

Everything is ``Column -> Column`` and stays on the JVM. The one exception is
Unicode composition (``nfc`` / ``nfkc``), which Spark has no built-in for: the
Arrow function there only receives the rows whose text can change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
SENTENCE_TERMINATORS = "。！？；!?;"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CJK = r"\u3400-\u4dbf\u4e00-\u9fff"
MAX_QUERY_CHARS = 400
MAX_TERMS = 64
MAX_TERM_CHARS = 64
CJK_TERM_AND_LIMIT = 6
# full-width or variant punctuation -> ASCII, applied after compatibility folding
PUNCT_FROM = "：，。、；（）％－–—﹣／．＊＋＝！？＜＞｜"
PUNCT_TO = ":,.,;()%----/.*+=!?<>|"
ORDINAL_FROM = "一二三四五"
ORDINAL_TO = "12345"
SEPARATORS = r"[^\p{L}\p{N}]+"
_DATE = r"\d{4}[-/.]\d{1,2}(?:[-/.]\d{1,2})?"
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
LABEL_RULES = {
    "error_code": (r"^[A-Z][A-Z0-9_]{0,63}$", "unknown", None),
    "reason": (r"^[A-Za-z][A-Za-z0-9_]{0,63}$", "unknown", None),
    "degraded": (r"^[a-z0-9_]{1,48}$", "unknown", None),
    "api_failure": (r"^[a-z0-9_]{1,48}$", "unknown", "unknown"),
    "exception": (r"^[A-Za-z][A-Za-z0-9_]{0,63}$", "unknown", "unknown"),
    "digest": (r"^[0-9a-f]{64}$", None, None),
    "outcome": (r"^(?:answered|refused|conflict)$", None, None),
}
GROUNDING_REASONS = (
    "not_json", "not_object", "bad_outcome", "bad_reason_code", "conflict_without_server_evidence", "reason_code_outcome_mismatch",
    "empty_answer", "answer_too_long", "bad_citation_list", "citation_out_of_range", "duplicate_citation", "refused_with_citations",
    "missing_citation", "missing_required_citation", "citation_marker_mismatch",
)
# --- end of fixed values ----------------------------------------------------


def _accent_table() -> tuple[str, str]:
    """Lower-case precomposed Latin/Greek/Cyrillic letters and their base letter."""
    src, dst = [], []
    for lo, hi in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)):
        for code in range(lo, hi):
            ch = chr(code)
            base = "".join(
                c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c)
            )
            if base != ch and len(base) == 1:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Plain column reuse would be inlined into every use, and inside an array lambda that
    means once per element.
    """
    return F.transform(F.array(value), body)[0]


# every character a text trim removes: Unicode white space and the four separators
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE))


def fold_accents(c: Column) -> Column:
    """Drop diacritics, composed or combining; plain ASCII passes untouched."""
    folded = F.regexp_replace(F.translate(c, ACCENTED, UNACCENTED), r"\p{Mn}+", "")
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(c)


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _nfkc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _casefold_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else v.casefold())


def nfc(c: Column) -> Column:
    """Canonical composition. Text made only of ASCII and precomposed Latin is already composed."""
    needs = c.rlike(r"[^\x00-\u02ff\u3001-\u3029\u4e00-\u9fff\uff01-\uff5e]")
    return F.coalesce(_nfc_udf(F.when(needs, c)), c)


def nfkc(c: Column) -> Column:
    needs = c.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_nfkc_udf(F.when(needs, c)), c)


def casefold(c: Column) -> Column:
    needs = c.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_casefold_udf(F.when(needs, c)), F.lower(c))


def norm_block(c: Column) -> Column:
    """Unify line ends, fold blanks, trim lines, drop empty lines."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, "[ \\t\\u3000]+", " ")
    return strip_ws(F.regexp_replace(t, r"(?U)\s*\n\s*", "\n"))


def norm_chunk(c: Column, compose: bool = True) -> Column:
    """Composition, control characters out, then ``norm_block``.

    ``compose=False`` skips the Arrow step for text known to be composed.
    """
    base = F.coalesce(c, F.lit(""))
    base = nfc(base) if compose else base
    return norm_block(F.regexp_replace(base, CONTROL_CHARS, ""))


def norm_search(c: Column, compose: bool = True) -> Column:
    """Index/query form: composed, no control characters, single spaces, lower case."""
    base = F.coalesce(c, F.lit(""))
    base = nfc(base) if compose else base
    t = F.regexp_replace(base, CONTROL_CHARS, "")
    return F.lower(strip_ws(F.regexp_replace(t, r"(?U)\s+", " ")))


def norm_match(c: Column, compose: bool = True) -> Column:
    """Comparison form: compatibility folding, ASCII punctuation, case folded, no white space."""
    base = F.coalesce(c, F.lit(""))
    if compose:
        t = casefold(F.translate(nfkc(base), PUNCT_FROM, PUNCT_TO))
    else:
        t = F.lower(F.translate(base, PUNCT_FROM, PUNCT_TO))
    return F.regexp_replace(t, r"(?U)\s+", "")


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """Render a typed cell: null -> '', booleans upper case, floats in their shortest digits.

    Integral floats have no fraction, others from 0.0001 on no exponent, smaller ones a two-digit
    exponent, as in 1e-05.
    """
    if isinstance(dtype, T.BooleanType):
        out = F.when(c, F.lit("TRUE")).when(~c, F.lit("FALSE"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        plain = c.cast("string")
        fixed = F.regexp_replace(c.cast("double").try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
        small = F.regexp_replace(F.regexp_replace(plain, r"\.0E-", "E-"), r"E-(\d)$", "E-0$1")
        finite = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
        out = (
            F.when(finite & (c == F.floor(c)) & (F.abs(c) < F.lit(9e18)), c.cast("bigint").cast("string"))
            .when(finite & (F.abs(c) >= F.lit(9e18)) & (F.abs(c) < F.lit(1e37)), c.cast("double").try_cast("decimal(38,0)").cast("string"))
            .when(finite & (F.abs(c) >= F.lit(1e-4)) & (c != F.floor(c)), fixed)
            .when(finite & (c != 0), F.lower(small))
            .otherwise(plain)
        )
    else:
        out = strip_ws(c.cast("string"))
    return F.coalesce(out, F.lit(""))


def kv_row(header: Column, values: Column) -> Column:
    """``name: value`` for non-empty cells, joined by a full-width semicolon."""
    parts = F.transform(
        values,
        lambda v, i: F.when(
            F.coalesce(v, F.lit("")) != "",
            F.concat(
                F.coalesce(
                    F.nullif(F.get(header, i), F.lit("")),
                    F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("列")),
                ),
                F.lit(": "),
                v,
            ),
        ),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "；")


def split_sentences(c: Column, terminators: str = SENTENCE_TERMINATORS) -> Column:
    """Cut after each terminator; the terminator stays with its sentence."""
    pieces = F.split(c, "(?<=[" + terminators + "])")
    return F.filter(F.transform(pieces, strip_ws), lambda p: p != "")


# --- query side -------------------------------------------------------------

def cjk_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([" + CJK + "]+)"), F.lit(1))


def _run_grams(run: Column) -> Column:
    n = F.length(run)
    return F.when(n == 1, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    )


def cjk_bigram_list(normalised: Column) -> Column:
    return F.flatten(F.transform(cjk_runs(normalised), _run_grams))


def cjk_bigrams(c: Column, compose: bool = True) -> Column:
    """Overlapping two-character grams of every CJK run, joined by blanks."""
    return F.array_join(cjk_bigram_list(norm_search(c, compose)), " ")


def query_terms(c: Column, compose: bool = True, max_terms: int | None = None) -> Column:
    """Separator-split terms of the normalised query, all of them unless ``max_terms`` says otherwise."""
    terms = F.split(norm_search(c, compose), SEPARATORS)
    terms = F.filter(terms, lambda t: t != "")
    return terms if max_terms is None else F.slice(terms, 1, max_terms)


def term_tokens(term: Column, max_chars: int | None = None) -> Column:
    """Sub-tokens of one term: CJK grams, then the other parts, first occurrence kept."""
    cut = term if max_chars is None else F.substring(term, 1, max_chars)
    other = F.filter(
        F.split(F.regexp_replace(cut, "[" + CJK + "]", " "), SEPARATORS), lambda t: t != ""
    )
    return F.array_distinct(F.concat(cjk_bigram_list(cut), other))


def term_is_loose(term: Column) -> Column:
    """A pure CJK run longer than six characters matches on any of its grams."""
    return term.rlike("^[" + CJK + "]+$") & (F.length(term) > CJK_TERM_AND_LIMIT)


def index_tokens(c: Column) -> Column:
    """Index-side words: lower case, no diacritics, runs of letters or digits.

    A CJK run stays one word here, exactly as a Unicode word tokenizer leaves it.
    """
    folded = fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), "")


# --- metadata and labels ----------------------------------------------------

def derive_meta(*texts: Column) -> Column:
    """Major, academic year, semester and course code found in title then file name."""
    joined = F.concat_ws(" ", *[F.nullif(strip_ws(t), F.lit("")) for t in texts])

    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(joined, pattern, 1), F.lit(""))

    year = F.nullif(F.regexp_extract(joined, r"(\p{Nd}{4}-\p{Nd}{4})", 1), F.lit(""))
    ordinal = F.translate(first("第([一二三四五])学期"), ORDINAL_FROM, ORDINAL_TO)
    return F.struct(
        F.nullif(strip_ws(first("大学(.+?)专业")), F.lit("")).alias("major"),
        year.alias("academic_year"),
        F.concat(year, F.lit("-"), ordinal).alias("semester"),
        first(r"(?U)\b([A-Z]{2,4}-[A-Z]{2,4}\d{3})\b").alias("course_code"),
    )


def first_wins_map(pairs: Column) -> Column:
    """array<struct<key,value>> -> map, keeping the first value of each key."""

    def kept(ps: Column) -> Column:
        return let(
            F.transform(ps, lambda p: p["key"]),
            lambda keys: F.filter(ps, lambda p, i: F.array_position(keys, p["key"]) == i + 1),
        )

    return F.map_from_entries(let(pairs, kept))


def segment_pairs(c: Column) -> Column:
    """``label：value`` segments split at semicolons, as array<struct<key,value>>.

    A segment is cut at its first full-width colon, else at its first ASCII colon.
    """

    def pair(seg: Column) -> Column:
        at = F.coalesce(F.nullif(F.instr(seg, "："), F.lit(0)), F.instr(seg, ":"))
        return let(
            at,
            lambda i: F.struct(
                strip_ws(F.substring(seg, F.lit(1), i - 1)).alias("key"),
                strip_ws(F.substring(seg, i + 1, F.length(seg))).alias("value"),
            ),
        )

    with_colon = F.filter(F.split(c, "[；;]"), lambda s: s.rlike("[：:]"))
    return F.transform(with_colon, pair)


def norm_term(c: Column) -> Column:
    """``YYYY-YYYY-N`` from a term label in either spelling; null when not recognisable."""
    pattern = r"(?U)(\d{4})\s*[-–—]\s*(\d{4})\s*(?:学年)?\s*[-第]?\s*([一二1-2])(?:\s*学期)?"
    hit = c.rlike(pattern)
    return F.when(
        hit,
        F.concat_ws(
            "-",
            F.regexp_extract(c, pattern, 1),
            F.regexp_extract(c, pattern, 2),
            F.translate(F.regexp_extract(c, pattern, 3), "一二", "12"),
        ),
    )


def parse_slot(c: Column) -> Column:
    """Weekday plus a period range or a clock range, as one struct; null when neither is valid."""
    period = r"第(\d{1,2})\s*-\s*(\d{1,2})节"
    clock = r"(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})"

    def num(pattern: str, group: int) -> Column:
        return F.regexp_extract(c, pattern, group).try_cast("int")

    read = F.struct(
        F.nullif(F.regexp_extract(c, "星期([一二三四五六日天])", 1), F.lit("")).alias("day"),
        num(period, 1).alias("p1"), num(period, 2).alias("p2"),
        (num(clock, 1) * 60 + num(clock, 2)).alias("c1"), (num(clock, 3) * 60 + num(clock, 4)).alias("c2"),
    )

    def choose(r: Column) -> Column:
        def slot(unit: str, start: str, end: str) -> Column:
            return F.struct(
                r["day"].alias("weekday"), F.lit(unit).alias("unit"), r[start].alias("start"), r[end].alias("end")
            )

        return F.when(
            r["day"].isNotNull(),
            F.when(r["p1"] <= r["p2"], slot("period", "p1", "p2")).when(r["c1"] <= r["c2"], slot("clock", "c1", "c2")),
        )

    return let(read, choose)


# --- anchors ----------------------------------------------------------------


def fact_anchors(normalised: Column) -> Column:
    """Dates, times, codes holding letters and digits, and numbers of already normalised text."""
    tokens = F.regexp_extract_all(
        normalised, F.lit(f"({_DATE}|{_TIME}|[a-z0-9][a-z0-9._-]*)"), F.lit(1)
    )
    keep = F.filter(
        tokens,
        lambda t: t.rlike(f"^(?:{_DATE}|{_TIME})$")
        | (t.rlike("[a-z]") & t.rlike("[0-9]"))
        | t.rlike(r"^\d+(?:\.\d+)?$"),
    )
    return F.array_distinct(keep)


def norm_section(c: Column) -> Column:
    """Fold white space and put single blanks around the ``>`` of a section path."""
    text = strip_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    segs = F.filter(F.transform(F.split(text, ">"), strip_ws), lambda s: s != "")
    return F.array_join(segs, " > ")


def base_name(c: Column) -> Column:
    """Last path segment."""
    return strip_ws(F.regexp_extract(c, r"([^/]*)$", 1))


def listed_label(c: Column, allowed: tuple[str, ...] = GROUNDING_REASONS) -> Column:
    """Keep a listed label, map other text to unknown and blanks to null: no free text passes."""
    text = strip_ws(c.cast("string"))
    return F.when(text.isin(*allowed), text).when(F.coalesce(text, F.lit("")) != "", F.lit("unknown"))


def norm_label(c: Column, kind: str) -> Column:
    """Keep a well-formed label, map other text to the fallback and blanks to the blank value."""
    pattern, fallback, blank = LABEL_RULES[kind]
    text = strip_ws(c.cast("string"))
    # \z and not $: a trailing line break must not pass
    strict = pattern.removesuffix("$") + r"\z"
    return (
        F.when(text.isNull() | (text == ""), F.lit(blank).cast("string"))
        .when(text.rlike(strict), text)
        .otherwise(F.lit(fallback).cast("string"))
    )
