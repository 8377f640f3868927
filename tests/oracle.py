"""Compare catalogue queries with DuckDB on the same parquet files.

``python tests/oracle.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veridoc.session import TABLE_NAMES, build_session  # noqa: E402

ROOT = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value + 0.0, 6))
    if isinstance(value, decimal.Decimal):
        return repr(round(float(value), 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(row[i]) for i in order) for row in data)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        diff = sorted(set(got) ^ set(expected))[:4]
        return f"rows {len(got)} != {len(expected)} {diff}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    mixed = [
        (n, spark_types[n], types[n]) for n in names
        if not same_kind(spark_types[n], types[n])
    ]
    return f"types {mixed}" if mixed else (None if got else "EMPTY")


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def same_kind(spark_type: str, duck_type: str) -> bool:
    if spark_type in KINDS:
        return KINDS[spark_type] == duck_type
    if spark_type.startswith("decimal"):
        return duck_type == spark_type.upper()
    if spark_type.startswith("array"):
        return duck_type.endswith("[]") or duck_type == "list"
    return True


def main() -> None:
    from veridoc.plans import CATALOGUE, runner

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(CATALOGUE)
    sf_dir = f"{ROOT}/sf{sf}"
    spark = build_session()
    con = connect(sf_dir)
    good = 0
    for name in names:
        start = time.time()
        try:
            df = runner(name)(spark, sf_dir)
            sql = CATALOGUE[name].sql
            if sql is None:
                note = f"rows only: {len(df.collect())}"
                good += 1
            else:
                note = compare(df, con, sql)
                good += note is None
        except Exception as error:  # noqa: BLE001
            note = "ERROR " + str(error).split("JVM stacktrace")[0][:700]
        print(f"{'ok  ' if note is None else '----'} {name:32s} {time.time() - start:6.2f}s {note or ''}", flush=True)
    print(good, "of", len(names))


if __name__ == "__main__":
    main()
