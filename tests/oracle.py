"""Run registered queries beside their SQL and compare rows, names and values.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences, empty when equal."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    if got != want:
        extra, missing = got - want, want - got
        out.append(f"rows {sum(got.values())} against {sum(want.values())}; "
                   f"{sum(extra.values())} only here, {sum(missing.values())} only there")
        for tag, side in (("here ", extra), ("there", missing)):
            for row in sorted(side, key=repr)[:2]:
                out.append(f"  {tag} {repr(row)[:600]}")
    return out


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from inkfold.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "10g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            if name in sql:
                diff = compare(df, con, sql[name])
            else:
                diff = [] if df.collect() else ["no rows"]
        except Exception as e:  # report and go on
            diff = [f"{type(e).__name__}: {str(e)[:1200]}"]
        bad += bool(diff)
        state = "FAIL" if diff else "ok  " if name in sql else "rows"
        print(f"{state} {name} {time.time() - start:.1f}s", flush=True)
        for line in diff:
            print("     ", line, flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
