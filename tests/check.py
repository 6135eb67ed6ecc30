"""Compare registered queries between Spark and DuckDB; also used by the test suite."""

from __future__ import annotations

import math
import os
import re
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, float):
        return f"{v:.9g}" if v != 0 else "0"
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    names = df.columns
    assert len(set(names)) == len(names), f"{name}: repeated column"
    if sql is None:
        return len(got), t1 - t0, None, f"{dict(df.dtypes)}"
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(names) != sorted(want_names):
        return len(got), t1 - t0, False, f"columns {sorted(names)} / {sorted(want_names)}"
    a, b = rows(names, got), rows(want_names, want)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    bad_types = {c: (t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]}
    note = f" types {bad_types}" if bad_types else ""
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return len(got), t1 - t0, False, f"{len(a)} / {len(b)} rows; {sorted(names)} first difference {diff}{note}"
    return len(got), t1 - t0, not bad_types, note


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    q, o = entry.queries(), entry.oracle_sql()
    for name, fn in q.items():
        if not pattern.search(name):
            continue
        try:
            n, sec, ok, note = compare(spark, con, folder, name, fn, o.get(name))
        except Exception as e:  # report and go on
            n, sec, ok, note = -1, 0.0, False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {name:26s} {n:8d} {sec:6.2f}s {note}", flush=True)
