"""Runs every query next to its SQL: python tests/oracle_check.py [folder] [query ...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


#: Spark's name of each DuckDB type.
FAMILY = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def as_bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(frame, con, sql: str) -> str | None:
    """None where both sides give the same rows, otherwise what differs."""
    start = time.time()
    result = con.sql(sql)
    columns = result.columns
    expected = as_bag(columns, result.fetchall())
    compare.sql_seconds = time.time() - start
    if frame.columns != columns:
        return f"columns {frame.columns} != {columns}"
    kinds = [(c, FAMILY.get(str(k), str(k)), t) for c, k, (_, t) in zip(columns, result.types, frame.dtypes) if FAMILY.get(str(k), str(k)) != t]
    if kinds:
        return f"types {kinds}"
    found = as_bag(frame.columns, [tuple(r) for r in frame.collect()])
    if found == expected:
        return None
    only_found, only_expected = found - expected, expected - found
    return (
        f"rows {found.total()} vs {expected.total()}, differing {only_found.total()}/{only_expected.total()}: "
        f"{sorted(map(str, only_found))[:2]} | {sorted(map(str, only_expected))[:2]}"
    )


def main() -> int:
    from chatloom.plans.oracle import oracle_queries
    from chatloom.plans.queries import REGISTRY
    from chatloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(folder), oracle_queries(), 0
    for name in sys.argv[2:] or REGISTRY:
        start = time.time()
        try:
            frame = REGISTRY[name](spark, folder)
            if name in oracle:
                problem = compare(frame, con, oracle[name])
            else:
                problem = f"rows only: {frame.count()}"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None and not problem.startswith("rows only")
        sql_seconds = getattr(compare, "sql_seconds", 0.0)
        print(f"{name:26s} {time.time() - start:7.2f}s (SQL {sql_seconds:.2f}s)  {problem or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
