"""Compare registered queries with their oracle SQL: ``python tests/oracle_check.py [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET threads = 4")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, db, sf_dir: str, query, sql: str | None) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if mine[1] else "no rows"
    result = db.execute(sql)
    theirs = normal([c[0] for c in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return f"first difference\n   spark {str(a)[:400]}\n   sql   {str(b)[:400]}"
    return ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, db = local_session(8), connect(folder)
    sqls = oracle_sql()
    for name, query in queries().items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, db, folder, query, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__} {str(e)[:1500]}"
        kind = "oracle" if name in sqls else "rows"
        print(f"{name:24s} {kind:6s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
