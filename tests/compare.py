"""Run named queries in Spark and their SQL in DuckDB, and compare all rows.

Usage: python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("noteworks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [_key(v) for v in r])


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


SECONDS: dict[str, float] = {}


def differences(spark, con, name: str, folder: str, limit: int = 3) -> list[str]:
    from noteworks.plans.catalog import CHECKS, QUERIES

    begin = time.time()
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    SECONDS[name] = time.time() - begin
    if name not in CHECKS:
        return [] if got else [f"{name}: no rows"]
    cur = con.execute(CHECKS[name])
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"{name}: columns {sorted(df.columns)} against {sorted(names)}"]
    out = []
    if len(got) != len(want):
        out.append(f"{name}: {len(got)} rows against {len(want)}")
    for g, w in zip(got, want):
        if len(out) >= limit:
            break
        if not all(same(x, y) for x, y in zip(g, w)):
            out.append(f"{name}: {str(g)[:300]} against {str(w)[:300]}")
    return out


def main() -> int:
    from noteworks.plans.catalog import CHECKS, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = session(), connect(folder), 0
    for name in names:
        begin = time.time()
        try:
            found = differences(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            found = [f"{name}: {type(error).__name__} {str(error)[:900]}"]
        bad += bool(found)
        state = "BAD " if found else ("ok  " if name in CHECKS else "rows")
        print(f"{state} {name} spark {SECONDS.get(name, 0):.1f}s all {time.time() - begin:.1f}s", flush=True)
        for line in found:
            print("     ", line, flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
