"""Runs registered queries next to their SQL and compares whole results.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from plumeria.session import local_session  # noqa: E402

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def spark_rows(spark, folder, name):
    df = queries()[name](spark, folder)
    return _rows(df.columns, df.collect())


def duck_rows(con, name):
    found = con.execute(oracle_sql()[name])
    return _rows([d[0] for d in found.description], found.fetchall())


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-9
    return a == b


def difference(left, right) -> str | None:
    """None when both results agree, else what differs first."""
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if not all(close(x, y) for x, y in zip(a, b)):
            return f"{a} against {b}"
        if any(type(x) is not type(y) for x, y in zip(a, b)):
            return f"types differ: {a} against {b}"
    return None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(queries())
    spark, con = local_session(8), duck(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            left = spark_rows(spark, folder, name)
            took = time.time() - start
            if name in oracle_sql():
                found = difference(left, duck_rows(con, name))
                verdict = "same" if found is None else "DIFFERENT " + found
            else:
                verdict = "no SQL"
        except Exception as error:  # noqa: BLE001
            took, verdict = time.time() - start, f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("same", "no SQL"))
        rows = len(left[1]) if not verdict.startswith("FAILED") else 0
        print(f"{name:40s} {took:6.2f}s {rows:8d} rows  {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad", flush=True)


if __name__ == "__main__":
    main()
