"""Run registered queries against DuckDB: python tests/oracle.py [sf] [name part ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return "NULL" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 2**53 else str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    if hasattr(x, "asDict"):
        return cell(list(x.asDict().values()))
    if isinstance(x, dict):
        return cell(sorted((cell(k), cell(v)) for k, v in x.items()))
    if type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    collected = [tuple(r) for r in df.collect()]
    print(f"     spark {time.time() - start:.2f}s", end=" ")
    mine = rows_of(df.columns, collected)
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}", len(mine[1])
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"rows {len(mine[1])} vs {len(theirs[1])}; only spark {sorted(a - b)[:3]}; only duck {sorted(b - a)[:3]}", len(mine[1])
    return "", len(mine[1])


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = argv[0] if argv else "0.001"
    parts = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, n = compare(spark, con, sf_dir, name, fn, oracles[name])
            else:
                n, problem = len(fn(spark, sf_dir).collect()), ""
        except Exception as exc:  # report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        bad += bool(problem)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {name:34s} {kind} n={n} {time.time() - start:.2f}s {problem}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
