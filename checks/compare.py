"""Run queries against their reference SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from .queries import ORACLE, QUERIES


def local_session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pixelseries")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """``None`` when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return None if got else "no rows"
    cursor = con.execute(ORACLE[name])
    want_names, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    if not got:
        return "both empty"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]  # repr also tells 0.0 from -0.0
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0][0]} / {bad[0][1]}"
    types = [(n, type(g), type(w)) for n, g, w in zip(got_names, got[0], want[0]) if g is not None and w is not None and type(g) is not type(w)]
    return f"types {types}" if types else None


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in args or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
