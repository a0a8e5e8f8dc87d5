"""Run every registered query and its SQL side by side: ``python tests/check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}"
    if hasattr(v, "item"):
        return cell(v.item())
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    started = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if sql is None:
        return len(rows), spent, "rows only" if rows else "EMPTY"
    started = time.time()
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    expected = out.fetchall()
    sql_spent = time.time() - started
    left, right = normal(df.columns, rows), normal(columns, expected)
    if left[0] != right[0]:
        return len(rows), spent, f"COLUMNS {left[0]} vs {right[0]}"
    if left[1] != right[1]:
        only_left = [r for r in left[1] if r not in set(right[1])][:2]
        only_right = [r for r in right[1] if r not in set(left[1])][:2]
        return len(rows), spent, f"DIFF {len(left[1])}/{len(right[1])}\n  spark {only_left}\n  sql   {only_right}"
    return len(rows), spent, f"ok (sql {sql_spent:.1f}s)" if rows else "EMPTY"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            n, spent, verdict = compare(spark, con, sf_dir, query, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            n, spent, verdict = -1, 0.0, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if not verdict.startswith(("ok", "rows only")):
            bad += 1
        print(f"{name:34s} {n:7d} rows {spent:6.2f}s  {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
