"""Secret scans: fixed patterns, and strings that a primed compressor finds new in a sensitive context.

The added kind, ``novel``, looks at every string of token characters that follows a sensitive word. A
zstandard compressor primed with a dictionary of identifiers and code words compresses the code
around the candidate without it and with it; the difference in bytes is what the string adds. It is
held against what random strings of the same length and alphabet add at the same place, so that the
bar follows the entropy of base64, hex or digits. A second compressor, primed with words that
identifiers are made of, tells names from noise: it sees the candidate cut into its words, and the
bar lies between what composed identifiers and random strings of that length add. Long candidates
are judged by windows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import bounded_batches

# The patterns that every scan reports.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# The method's own values.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "credential", "private_key", "private key", "bearer", "authorization", "access_key", "signature")
CONTEXT = 96  # code points kept on each side
REACH = 48  # how far before the candidate a sensitive word may stand, on the same line
CANDIDATE_LEAST = 16
MARGIN = 1.0  # a candidate of n characters adds 1 - MARGIN / sqrt(n) of what a random string adds, whose deviation falls likewise
DRAWS = 3  # random strings that a candidate is held against
WINDOW = 64  # longer candidates are judged by windows of this length, half overlapping
PLACEHOLDER = "[secret]"
CALIBRATION = 64  # composed identifiers and random strings that set each bar between names and noise
LENGTH_STEP = 4  # bars are set for lengths rounded to this
NAMES_PASS = 1.7  # deviations above the mean of composed identifiers below which nothing is reported
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % CANDIDATE_LEAST)

IDENTIFIERS = (
    "import from return class public static private final void string const let var function def self this new null none true false "
    "if else for while try except catch raise throw async await config settings environment getenv os.environ process.env client "
    "request response header headers content-type application/json authorization bearer basic username user password passwd secret "
    "token api_key apikey access_key private_key client_id client_secret session cookie session_id database connection host port "
    "localhost example.com http:// https:// www. .com .org .net .json .html .yaml .xml index default value name type id key data "
    "path file url endpoint region bucket account service server version timeout enabled disabled debug production staging test "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxx XXXXXXXX 00000000 ........ -------- ________ "
)

# Words that names are made of: the first prime the compressor, the last (UNSEEN) compose the identifiers that set the bar.
VOCABULARY = (
    "access account action active add address after all allow app array async attribute auth available back base before block body "
    "bool buffer build byte cache call change channel char check child class clear client close code column command common compare "
    "complete config connect content context control convert copy count create current custom data date default delete depend "
    "description detail dir display document domain edit element encode end entry error event exception execute expire export extract "
    "field file filter find first flag format forward from function generate group handle hash head hidden home host image import index "
    "info init input insert install instance integer internal item iterate join key label language last length level limit line link list "
    "load local lock log login main make manage map match max member message method mode module name network next node number object "
    "option order output package page param parse path pattern point policy port prefix print process profile property provider proxy"
).split()
UNSEEN = (
    "query queue range record refresh register release remote remove render request reset resolve response result retry role route rule "
    "sample schema scope search secure segment select sequence service session signature socket source status storage stream string "
    "submit support system target template thread timeout token track transform unit update upload valid verify version worker"
).split()
ENDINGS = ("", "", "", "", "s", "ed", "ing", "er", "ion", "able", "ment")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_JOINT = re.compile(r"[+/_=.~ -]+")


@lru_cache(maxsize=8)
def _compressor(dictionary: str) -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)


def alphabet(s: str) -> str:
    """The least of digits, hex digits or whole classes of letters and digits that holds the string, with its other characters."""
    used = set(s)
    for whole in (string.digits, "0123456789abcdef", "0123456789ABCDEF"):
        if used <= set(whole):
            return whole
    classes = [c for c in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if used & set(c)]
    return "".join([*classes, *sorted(used - set(string.ascii_letters + string.digits))])


@lru_cache(maxsize=1 << 12)
def _random_strings(letters: str, size: int) -> tuple[bytes, ...]:
    rng = random.Random(f"{size} {letters}")
    return tuple("".join(rng.choices(letters, k=size)).encode() for _ in range(DRAWS))


def novelty(candidate: str, before: str, after: str, dictionary: str = IDENTIFIERS) -> float:
    """Bytes that the candidate adds to its compressed surroundings, as a share of what a random string adds.

    Capitals alone say no more than small letters: they are lowered with the surroundings.
    """
    if candidate.isupper():
        candidate, before, after = candidate.lower(), before.lower(), after.lower()
    compress = _compressor(dictionary).compress
    around = (before + "\n" + after).encode()
    alone = len(compress(around))
    chance = sum(len(compress(around + b"\n" + r)) - alone for r in _random_strings(alphabet(candidate), len(candidate))) / DRAWS
    return (len(compress(around + b"\n" + candidate.encode())) - alone) / chance


def _words(count: int, vocabulary: list[str] | tuple[str, ...], seed: str) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) + rng.choice(ENDINGS) for _ in range(count))


@lru_cache(maxsize=1)
def _names() -> tuple[zstandard.ZstdCompressor, str, int]:
    """The compressor of names, the words that stand before each candidate, and their compressed size."""
    primer = (_words(4 * len(VOCABULARY), VOCABULARY, "primer") + " " + " ".join(VOCABULARY)).encode()
    shape = zstandard.ZstdCompressionParameters.from_level(
        19, source_size=2048, dict_size=len(primer), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    compressor = zstandard.ZstdCompressor(compression_params=shape, dict_data=zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    before = _words(150, VOCABULARY, "before")
    return compressor, before, len(compressor.compress(before.encode()))


def name_bytes(candidate: str) -> float:
    """Bytes per character that the candidate, cut into words at humps, joints and digits, adds to a text of words."""
    compressor, before, alone = _names()
    cut = _JOINT.sub(" ", _HUMP.sub(" ", candidate)).lower()
    return (len(compressor.compress(f"{before} {cut}".encode())) - alone) / len(candidate)


def _spread(strings: list[str]) -> tuple[float, float]:
    found = [name_bytes(s) for s in strings]
    mean = sum(found) / len(found)
    return mean, (sum((x - mean) ** 2 for x in found) / len(found)) ** 0.5


@lru_cache(maxsize=1 << 10)
def _composed(size: int) -> tuple[float, float]:
    """Mean and deviation of ``name_bytes`` over identifiers of ``size`` characters, half their words not in the primer."""
    out = []
    for i in range(CALIBRATION):
        words = _words(size, UNSEEN if i % 2 else VOCABULARY, f"{size} {i}").split()
        style = i // 2 % 4
        name = "".join(w.capitalize() for w in words) if style == 0 else "_-/"[style - 1].join(words)
        out.append(name[:size - 1] + "2" if i % 8 == 7 else name[:size])
    return _spread(out)


@lru_cache(maxsize=1 << 12)
def name_bar(letters: str, size: int) -> float:
    """The value of ``name_bytes`` from which a string of this alphabet and length is noise.

    It lies as many deviations above composed identifiers as below random strings, and never so low that composed
    identifiers pass. Random small letters alone cost little more than names: of them only the longer ones pass.
    """
    rng = random.Random(f"bar {size} {letters}")
    noise, noise_spread = _spread(["".join(rng.choices(letters, k=size)) for _ in range(CALIBRATION)])
    names, names_spread = _composed(size)
    between = (names * noise_spread + noise * names_spread) / max(names_spread + noise_spread, 1e-9)
    return max(between, names + NAMES_PASS * names_spread)


def is_name(candidate: str) -> bool:
    """Whether the candidate reads as words rather than noise. Digits alone are no name."""
    letters = "".join(c for c in alphabet(candidate) if c.isalnum())
    if not set(letters) - set(string.digits):
        return False
    return name_bytes(candidate) < name_bar(letters, max(LENGTH_STEP, len(candidate) // LENGTH_STEP * LENGTH_STEP))


def _novel(text: str, froms: list[int], b: int, margin: float, dictionary: str) -> bool:
    """Whether the string up to b, from any of the sorted starts, or any window of it is as new as chance."""
    last = max(b - WINDOW, froms[0])
    at = sorted({*range(froms[0], last + 1, WINDOW // 2), last, *froms})
    ends = [min(b, i + WINDOW) for i in at]
    return any(
        novelty(text[i:j], text[max(0, i - CONTEXT):i], text[j:j + CONTEXT], dictionary) >= 1 - margin / (j - i) ** 0.5 and not is_name(text[i:j])
        for i, j in zip(at, ends)
    )


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each kind leftmost and without overlap."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def novel_spans(text: str, taken: list[tuple[int, int, str]], margin: float = MARGIN, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """Incompressible strings that start within reach of a sensitive word, or go on after it, outside the spans of ``taken``."""
    low = text.lower()
    at: set[int] = set()
    for word in SENSITIVE if len(low) == len(text) else ():
        i = low.find(word)
        while i >= 0:
            at.add(i + len(word))
            i = low.find(word, i + 1)
    if len(low) != len(text):  # lower-casing moved positions: look for the words in place
        at = {m.end() for m in re.finditer("|".join(map(re.escape, SENSITIVE)), text, re.ASCII | re.IGNORECASE)}
    free = _free(text, taken) if at else []
    starts = [a for a, _ in free]
    judged: dict[int, list[int]] = {}
    for end in sorted(at):
        i = bisect_right(starts, end) - 1
        if i >= 0 and free[i][1] - end >= CANDIDATE_LEAST:  # a string goes on after the word
            judged.setdefault(i, []).append(end)
        line = text.find("\n", end, end + REACH + 1)
        stop = line if line >= 0 else end + REACH
        for k in range(bisect_right(starts, end), bisect_right(starts, stop)):
            judged.setdefault(k, []).append(starts[k])
    return [
        (froms[0], b, "novel") for froms, b in ((sorted(set(judged[k])), free[k][1]) for k in sorted(judged))
        if _novel(text, froms, b, margin, dictionary)
    ]


def _free(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The strings of token characters, less the sorted spans, that are long enough to be candidates."""
    out, k = [], 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            out.append((a, taken[k][0]))
            a = max(a, taken[k][1])
            if taken[k][1] > b:  # goes on into the next string
                break
            k += 1
        out.append((a, b))
    return [(a, b) for a, b in out if b - a >= CANDIDATE_LEAST]


def spans(text: str, margin: float = MARGIN, dictionary: str = IDENTIFIERS) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed in ``KINDS``."""
    base = sorted(base_spans(text))
    found = base + novel_spans(text, base, margin, dictionary)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, found: list[tuple[int, int, str]], placeholder: str = PLACEHOLDER) -> str:
    """The text with every span, overlapping ones together, replaced by the placeholder."""
    out, at, upto = [], 0, -1
    for start, end, _ in sorted(found):
        if start >= upto:
            out += [text[at:start], placeholder]
        upto = max(upto, end)
        at = upto
    return "".join([*out, text[at:]])


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) for every row.

    A null text counts as empty. Positions are code points, ends exclusive. Repeated ids give a row
    each, an empty table none; other columns are not looked at. Every row is scanned whole and alone.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {k: [] for k in KINDS}
            digests, all_spans = [], []
            for t in batch.column(1).to_pylist():
                found = spans(t or "", margin)
                for k in KINDS:
                    counts[k].append(sum(x[2] == k for x in found))
                digests.append(hashlib.sha256(_joined([x for x in found if x[2] != "novel"]).encode()).hexdigest())
                all_spans.append(_joined(found))
            longs = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), longs["assign"], longs["access"], longs["hex"], pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), longs["novel"]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
            )

    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def without_secrets(docs: DataFrame, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by a placeholder; null texts stay null."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([t and redact(t, spans(t, margin)) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, clean(F.col(text).cast("string")))
