"""Compare registered queries with their SQL, in DuckDB, on the same parquet files.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import signal
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.ui.showConsoleProgress","false")
        .appName("shelfmark-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"{type(v).__name__ if not isinstance(v, (int, str)) else ''}{v}"


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    t1 = time.time() - t0
    if sql is None:
        return f"rows-only {len(got)} rows, {t1:.1f}s", True, t1
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"COLUMNS spark={cols} sql={sorted(names)}", False, t1
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    if got == want:
        return f"ok {len(got)} rows, {t1:.1f}s" + (" EMPTY" if not got else ""), True, t1
    got_set, want_set = set(got), set(want)
    only_got = [r for r in got if r not in want_set][:3]
    only_want = [r for r in want if r not in got_set][:3]
    return (
        f"MISMATCH spark={len(got)} sql={len(want)} cols={cols}\n    spark only: {only_got}\n    sql only: {only_want}"[:2500],
        False,
        t1,
    )


def too_long(*_):
    raise TimeoutError("query took too long")


signal.signal(signal.SIGALRM, too_long)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = argv[1:]
    spark, con = session(), duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad, total = [], 0.0
    for name in qs:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            signal.alarm(int(os.environ.get("QUERY_SECONDS", "60")))
            msg, ok, t = compare(spark, con, name, qs[name], sqls.get(name), sf)
            total += t
        except Exception as exc:  # report and go on with the next query
            msg, ok = f"ERROR {type(exc).__name__}: {str(exc)[:900]}", False
            spark.sparkContext.cancelAllJobs()
        finally:
            signal.alarm(0)
        print(f"{name}: {msg}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing, {total:.0f}s: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
