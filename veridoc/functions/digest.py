"""Content digests: stable JSON digests, chunk ids, hash scores and hash vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\u001f"
LOCATOR_FIELDS = (
    "block_end", "block_start", "page_number", "row_end", "row_start",
    "section_title", "sheet_name",
)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls are kept, text is not escaped beyond JSON rules."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def stable_digest(fields: Mapping[str, Column]) -> Column:
    return sha256(canonical_json(fields))


def document_checksum(source_type: Column, source_key: Column, file_sha: Column) -> Column:
    """Binds the file digest to its source, so equal files of two sources stay apart."""
    return sha256(F.concat_ws(UNIT_SEPARATOR, source_type, source_key, file_sha))


def chunk_id(
    checksum: Column, locator: Column, chunk_index: Column, parser_version: str, chunker_version: str
) -> Column:
    """Content-derived id of one chunk; ``locator`` is a struct with ``LOCATOR_FIELDS``."""
    json = canonical_json({name: locator[name] for name in LOCATOR_FIELDS})
    return sha256(
        F.concat_ws(
            UNIT_SEPARATOR, checksum, json, chunk_index.cast("string"),
            F.lit(parser_version), F.lit(chunker_version),
        )
    )


def hash_score(query: Column, text: Column) -> Column:
    """Deterministic score in [0, 1] from the first eight digest bytes of query, NUL, text."""
    digest = sha256(F.concat(query, F.lit("\u0000"), F.coalesce(text, F.lit(""))))
    raw = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return raw / F.lit(float(0xFFFFFFFFFFFFFFFF))


def hash_vector(text: Column, dim: int) -> Column:
    """Deterministic unit vector from digest blocks of the text digest and a block counter."""
    seed = F.unhex(sha256(F.coalesce(text, F.lit(""))))
    blocks = (dim + 7) // 8
    hexes = F.concat(
        *[sha256(F.concat(seed, F.unhex(F.lit(f"{i:08x}")))) for i in range(blocks)]
    )
    words = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(hexes, i * 8 + 1, F.lit(8)), 16, 10).cast("double")
        / F.lit(4294967295.0) * 2.0 - 1.0,
    )
    return _unit(words)


def _unit(words: Column) -> Column:
    def scaled(acc: Column) -> Column:
        norm = F.sqrt(F.aggregate(acc, F.lit(0.0), lambda s, v: s + v * v))
        return F.transform(acc, lambda v: v / F.when(norm == 0.0, F.lit(1.0)).otherwise(norm))

    # one-element detour so that the word list is computed once per row
    return F.transform(F.array(words), scaled)[0]


def short_digest(prefix: str, c: Column, length: int = 12) -> Column:
    return F.substring(sha256(F.concat(F.lit(prefix), c)), 1, length)
