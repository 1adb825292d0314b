"""Run registered queries next to their SQL in DuckDB and compare the full results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, decimal.Decimal):
        return "decimal"
    if isinstance(value, dt.date):
        return "date"
    return type(value).__name__


def text(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    kinds = [set() for _ in order]
    out = []
    for row in rows:
        for pos, i in enumerate(order):
            if row[i] is not None:
                kinds[pos].add(kind(row[i]))
        out.append(tuple(text(row[i]) for i in order))
    return sorted(names), kinds, sorted(out)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise a description of the first difference."""
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[2]) != len(want[2]):
        return f"rows {len(got[2])} != {len(want[2])}"
    for name, a, b in zip(got[0], got[1], want[1]):
        if a and b and a != b:
            return f"type of {name}: {a} != {b}"
    for a, b in zip(got[2], want[2]):
        if a != b:
            n = len(set(got[2]) ^ set(want[2]))
            return f"values differ ({n} rows off): {a} != {b}"
    return None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                n = "ok"
            else:
                problem, n = None, f"rows only: {df.count()}"
        except Exception as exc:  # report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:600]}", ""
        bad += problem is not None
        print(f"{name:34s} {time.time() - t:6.2f}s {problem or n}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
