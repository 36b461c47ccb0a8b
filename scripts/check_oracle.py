"""Run every registered query in Spark and its SQL oracle in DuckDB and compare.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
$CHECK_CONF takes extra Spark settings as "key=value,key=value" (e.g.
spark.sql.autoBroadcastJoinThreshold=-1 to check the sort-merge plans used
at scale).
Compares row count, column names and an order-insensitive hash of the values
(columns sorted by name), like the driver's correctness gate.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from overhaul import build_session, suite  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "nan"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
                   "double": "DOUBLE", "boolean": "BOOLEAN"}


def type_diff(df, rel):
    mine = {c: SPARK_TO_DUCKDB.get(t, t.upper()) for c, t in df.dtypes}
    theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (mine[c], theirs.get(c)) for c in mine if mine[c] != theirs.get(c)}


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(suite.QUERIES)
    extra = dict(kv.split("=", 1) for kv in os.environ.get("CHECK_CONF", "").split(",") if kv)
    spark = build_session("local[8]", 8, extra=extra)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    bad = 0
    for name in names:
        t0 = time.time()
        df = suite.QUERIES[name](spark, sf_dir)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        ts = time.time() - t0
        sql = suite.ORACLES.get(name)
        if sql is None:
            print(f"{name:32s} rows={len(rows):7d} spark={ts:5.2f}s  (no oracle)")
            continue
        types = type_diff(df, con.sql(sql))
        cur = con.execute(sql)
        ocols = [c[0] for c in cur.description]
        orows = cur.fetchall()
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and h1 == h2 and not types
        bad += not ok
        print(f"{name:32s} rows={len(rows):7d}/{len(orows):7d} cols={'ok' if sorted(cols) == sorted(ocols) else 'DIFF'}"
              f" types={'ok' if not types else 'DIFF'} hash={'ok' if h1 == h2 else 'DIFF'} spark={ts:5.2f}s")
        if not ok:
            print("   spark cols:", sorted(cols), "\n   oracle cols:", sorted(ocols), "\n   types:", types)
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:3]:
                print("   only spark :", x[:300])
            for x in sorted(s2 - s1)[:3]:
                print("   only oracle:", x[:300])
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
