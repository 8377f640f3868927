"""Reconciliation by digest tree: rows are joined only where two sides are known to differ.

Rows are dealt by a hash of their key into leaves. A leaf's digest (count, exclusive or and two sums of row
hashes) combines in any order, so it is reduced in the map tasks, may be stored beside a table, and adds up to the
digest of a branch of leaves. Branches are compared first, then the leaves of unequal branches; equal leaves hold the
same rows (up to a chance of about 2^-64) and never reach a join.

Keys are unique on each side. A row with a null key part equals no row, as in a join: its hash names its side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAVES = 1 << 16
FANOUT = 1 << 8
_DIGEST = ("n", "x", "lo", "hi")


def leaf_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(LEAVES)).cast("int")


def row_hash(keys: list[str], mark: Column, side: str) -> Column:
    """Hash of key and mark; null parts count by place, and a null key ties the row to its side."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return F.xxhash64(*keys, mark, mark.isNull(), F.when(null, F.lit(side)).otherwise(F.lit("")))


def digest(h: Column) -> list[Column]:
    """A combinable digest of row hashes; both sums stay below 2^63 for two billion rows."""
    return [
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("hi"),
    ]


def leaves(rows: DataFrame, keys: list[str], mark: Column, side: str) -> DataFrame:
    """(leaf, n, x, lo, hi): at most ``LEAVES`` rows for a table of any size."""
    return rows.select(leaf_of(keys).alias("leaf"), row_hash(keys, mark, side).alias("h")).groupBy("leaf").agg(*digest(F.col("h")))


def branches(leaf_digests: DataFrame) -> DataFrame:
    """The level above: digests of ``FANOUT`` neighbouring leaves, from the leaves alone."""
    return leaf_digests.groupBy(F.floor(F.col("leaf") / FANOUT).alias("branch")).agg(
        F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi")
    )


def _unequal(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    packed = [d.select(on, F.struct(*_DIGEST).alias(side)) for d, side in ((left, "l"), (right, "r"))]
    return packed[0].join(packed[1], on, "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select(on)


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """(leaf): leaves whose digests differ, found below unequal branches only."""
    top = _unequal(branches(left), branches(right), "branch")
    below = [d.join(top, F.floor(F.col("leaf") / FANOUT) == F.col("branch"), "left_semi") for d in (left, right)]
    return _unequal(*below, "leaf")


def compare(left: DataFrame, right: DataFrame, keys: list[str], left_mark: Column, right_mark: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of ``left`` in equal leaves, rows of ``left`` and rows of ``right`` in unequal ones)."""
    apart = differing_leaves(leaves(left, keys, left_mark, "left"), leaves(right, keys, right_mark, "right"))

    def part(rows: DataFrame, how: str) -> DataFrame:
        return rows.withColumn("_leaf", leaf_of(keys)).join(apart, F.col("_leaf") == F.col("leaf"), how).drop("_leaf")

    return part(left, "left_anti"), part(left, "left_semi"), part(right, "left_semi")
