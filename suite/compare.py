"""Run check queries on Spark and on DuckDB and compare them.

    python -m suite.compare <data folder> [name part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

import suite.all_checks  # noqa: F401  (fills the registry)
from stockcast.session import build_session
from suite.base import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return None if value != value else float(f"{value:.9g}") + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def main(folder: str, parts: list[str]) -> int:
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    failed = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            got = rows_of(df.columns, df.collect())
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows {name}: {len(got)} rows {spent:.1f}s", flush=True)
                continue
            cursor = con.execute(ORACLES[name])
            names = [c[0] for c in cursor.description]
            want = rows_of(names, cursor.fetchall())
        except Exception as exc:  # report and go on with the next query
            failed += 1
            print(f"FAIL {name}: {type(exc).__name__} {str(exc)[:900]}", flush=True)
            continue
        if sorted(names) != sorted(df.columns):
            failed += 1
            print(f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(names)}")
        elif got != want:
            failed += 1
            bad = [(g, w) for g, w in zip(got, want) if g != w]
            print(f"FAIL {name}: {len(got)} vs {len(want)} rows, {len(bad)} differ; {sorted(names)}\n   {bad[0] if bad else ''}", flush=True)
        else:
            print(f"ok   {name}: {len(got)} rows {spent:.1f}s", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
