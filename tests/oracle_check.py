"""Compare every registered query with its SQL on the given tables.

Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(name: str) -> str:
    name = name.lower()
    if "int" in name or name in ("long", "short"):
        return "int"
    if name in ("string", "varchar"):
        return "text"
    return name


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(value):
        if value is None or (isinstance(value, float) and pd.isna(value)):
            return "NULL"
        return repr(value + 0.0) if isinstance(value, float) else repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str:
    """Empty if names, kinds and all values agree, else what differs."""
    got = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: _kind(str(d[1])) for d in cursor.description}
    want = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    spark_kinds = {f.name: _kind(f.dataType.typeName()) for f in df.schema.fields}
    if spark_kinds != kinds:
        return f"types {[(n, spark_kinds[n], kinds[n]) for n in names if spark_kinds[n] != kinds[n]]}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from sonarium.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or list(queries):
        began = time.time()
        try:
            if name in oracle:
                problem = compare(queries[name](spark, sf_dir), con, oracle[name])
            else:
                problem = "" if queries[name](spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        failed += bool(problem)
        mark = "FAIL" if problem else ("same" if name in oracle else "rows")
        print(f"{mark} {name} {time.time() - began:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
