"""Strict JSON reading on top of variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridoc.functions.text import let


def strict_json(text: Column) -> Column:
    """Variant of a text that is exactly one JSON value; null otherwise.

    The parser stops after the first value, so the text is also read inside an array and
    inside an object: trailing characters break one of the two.
    """

    def read(x: Column) -> Column:
        in_list = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        in_object = F.try_parse_json(F.concat(F.lit('{"a":'), x, F.lit("}")))
        single = F.size(F.try_variant_get(in_list, "$", "array<variant>")) == 1
        return F.when(single & in_object.isNotNull(), F.try_variant_get(in_list, "$[0]", "variant"))

    return let(text, read)


def kind(v: Column) -> Column:
    """Type name of a variant; absent and JSON null are both VOID."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_member(v: Column, path: str) -> Column:
    """Value of a JSON string member; null for any other type."""
    return F.when(kind(member(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def integer(v: Column) -> Column:
    """Value of a JSON integer; null for booleans, fractions and texts."""
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def is_list(v: Column) -> Column:
    return F.startswith(kind(v), F.lit("ARRAY"))


def is_object(v: Column) -> Column:
    return F.startswith(kind(v), F.lit("OBJECT"))


def keys(v: Column) -> Column:
    return F.json_object_keys(F.to_json(v))


def elements(v: Column) -> Column:
    """Elements of a JSON list; null for any other type."""
    return F.try_variant_get(v, "$", "array<variant>")


def has(v: Column, name: str) -> Column:
    """The object has the member, be it null."""
    return F.coalesce(F.array_contains(keys(v), name), F.lit(False))
