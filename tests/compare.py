"""Runs a query on Spark and its SQL twin on DuckDB and compares the rows.

Usage: python tests/compare.py SF_DIR [name or prefix*, ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf_dir):
    """(spark rows, oracle rows or None, difference or '')"""
    got = q.run(spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    sql = q.oracle()
    if sql is None:
        return len(rows), None, ""
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(got.columns) != sorted(rel.columns):
        return len(rows), len(want), f"columns {got.columns} <> {rel.columns}"
    a, b = _rows(got.columns, rows), _rows(rel.columns, want)
    if a == b:
        return len(rows), len(want), ""
    extra, lost = list((a - b).items()), list((b - a).items())
    return len(rows), len(want), (
        f"cols {sorted(got.columns)}\n  only spark ({sum((a - b).values())}): {extra[:3]}\n"
        f"  only oracle ({sum((b - a).values())}): {lost[:3]}"
    )


if __name__ == "__main__":
    from __spark_entry__ import _queries
    from mendframe.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, q in _queries().items():
        if wanted and not any(
            name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted
        ):
            continue
        t = time.time()
        try:
            n, m, diff = compare(spark, con, q, sf_dir)
        except Exception as e:
            n, m, diff = -1, -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok':4} {name:32} {n:>8} {str(m):>8} {time.time() - t:6.2f}s {diff}", flush=True)
    print("failures:", bad)
