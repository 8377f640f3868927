"""Display-name checks and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridoc.functions.privacy import scrub
from veridoc.functions.text import casefold, nfc, strip_ws

# --- fixed values -----------------------------------------------------------
MAX_NAME = 200
MAX_DISPLAY = 80
LOOKALIKES = r"[\u2044\u2215\u2216\u29f5\u29f8\ufe68\uff0f\uff3c]"
BIDI = r"[\u202a-\u202e\u2066-\u2069\u200e\u200f\u206a-\u206f\ufeff]"
RESERVED = r"^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])$"
UNSAFE_DISPLAY = r"""[\\/:*?"<>|\x00-\x1f\x7f]"""
# --- end of fixed values ----------------------------------------------------


def name_violation(raw: Column, compose: bool = True) -> Column:
    """The first reason why a display name is unsafe; null when it is fine."""
    name = F.coalesce(raw, F.lit(""))
    name = nfc(name) if compose else name
    stem = F.split(name, r"\.")[0]
    stem = casefold(stem) if compose else F.lower(stem)
    rules = (
        ("empty", name.isin("", ".", "..")),
        ("too_long", F.length(name) > MAX_NAME),
        ("surrounding_whitespace", name.rlike(r"(?U)^\s|\s\z")),
        ("control_character", name.rlike(r"[\x00-\x1f\x7f]")),
        ("path_separator", name.rlike(r"[/\\]")),
        ("separator_lookalike", name.rlike(LOOKALIKES)),
        ("bidi_control", name.rlike(BIDI)),
        ("parent_reference", F.contains(name, F.lit(".."))),
        ("drive_letter", name.rlike(r"^[A-Za-z]:")),
        ("trailing_space_or_dot", name.rlike(r"[ .]\z")),
        ("reserved_device_name", stem.rlike(RESERVED)),
    )
    out = None
    for reason, hit in rules:
        out = F.when(hit, F.lit(reason)) if out is None else out.when(hit, F.lit(reason))
    return out


def safe_name(raw: Column) -> Column:
    """Unsafe characters out, blanks folded, at most 80 characters, personal data scrubbed."""
    spaced = F.regexp_replace(strip_ws(F.coalesce(raw, F.lit(""))), UNSAFE_DISPLAY, " ")
    folded = strip_ws(F.regexp_replace(spaced, r"(?U)\s+", " "))
    return F.nullif(scrub(F.substring(folded, 1, MAX_DISPLAY)), F.lit(""))


def record_set_name(stem: Column) -> Column:
    """``NN-a-b`` -> ``b · a``; names of another shape are only cleaned."""
    parts = F.filter(F.split(F.coalesce(stem, F.lit("")), "[-_]"), lambda p: strip_ws(p) != "")
    parts = F.when(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).rlike(r"^(?U)\d+$"),
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
    ).otherwise(parts)
    joined = F.concat(F.get(parts, F.size(parts) - 1), F.lit(" · "), F.get(parts, F.lit(0)))
    return safe_name(F.when(F.size(parts) >= 2, joined).otherwise(stem))
