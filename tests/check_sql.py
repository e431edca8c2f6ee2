"""Runs registered queries next to their SQL: python tests/check_sql.py <sf dir> [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(repr(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    left_names, left = normal([tuple(r) for r in df.collect()], df.columns)
    t1 = time.time()
    if sql is None:
        return True, f"rows {len(left)}  spark {t1 - t0:.1f}s  (no SQL)"
    cur = con.execute(sql)
    right_names, right = normal(cur.fetchall(), [d[0] for d in cur.description])
    t2 = time.time()
    text = f"rows {len(left)}/{len(right)}  spark {t1 - t0:.1f}s  sql {t2 - t1:.1f}s"
    if left_names != right_names:
        return False, f"{text}  columns {left_names} / {right_names}"
    if left != right:
        diff = [x for x in zip(left, right) if x[0] != x[1]]
        both = set(left) & set(right)
        only_l = [x for x in left if x not in both][:3]
        only_r = [x for x in right if x not in both][:3]
        return False, f"{text}  {len(diff)} differ\n   spark {str(only_l)[:600]}\n   sql   {str(only_r)[:600]}"
    return True, text


def main() -> None:
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracle = entry.queries(), entry.oracle_sql()
    spark, con = session(), duck(sf_dir)
    bad = []
    for name in names or list(queries):
        try:
            ok, text = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        spark.catalog.clearCache()
        print(("ok   " if ok else "FAIL ") + f"{name:24s} {text}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", " ".join(bad) or "none")


if __name__ == "__main__":
    main()
