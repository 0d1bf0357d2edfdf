"""Run every registered query against its SQL: python tests/check_oracle.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from cilode.session import session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def compare(spark, db, folder: str, name: str) -> str | None:
    """None if both sides give the same rows under the same column names."""
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in cursor.fetchall())
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return f"{len(got)} rows against {len(want)}; only here {extra}; only there {missing}"
    return None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session("check", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__master="local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, db, folder, name)
        except Exception as failure:
            problem = f"{type(failure).__name__}: {str(failure)[:1500]}"
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'ok'}", flush=True)
