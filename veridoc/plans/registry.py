"""The query catalogue: name -> (DataFrame function, optional SQL for the comparison engine)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from veridoc.session import Tables


@dataclass(frozen=True)
class Entry:
    name: str
    operators: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Entry] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register a query; ``operators`` lists the blueprint ids it covers."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Entry(name, operators, fn, sql)
        return fn

    return wrap


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = CATALOGUE[name]

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.run(Tables(spark, sf_dir))

    call.__name__ = name
    return call
