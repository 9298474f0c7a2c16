"""Run a query and its SQL twin over the same tables and compare all values."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normalized(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__ if not isinstance(value, float) else "float"


def compare(spark, name, function, sql, sf_dir, con=None):
    """(problem or None, rows, seconds)."""
    started = time.time()
    frame = function(spark, sf_dir)
    ours = [tuple(row) for row in frame.collect()]
    seconds = time.time() - started
    if sql is None:
        return None, len(ours), seconds
    cursor = (con or connect(sf_dir)).execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(frame.columns) != sorted(theirs_columns):
        return f"columns {sorted(frame.columns)} != {sorted(theirs_columns)}", len(ours), seconds
    left, right = normalized(ours, frame.columns), normalized(theirs, theirs_columns)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}", len(ours), seconds
    names = sorted(frame.columns)
    for x, y in zip(left, right):
        if x != y or [kind(v) for v in x] != [kind(v) for v in y]:
            differing = [(n, a, b) for n, a, b in zip(names, x, y) if a != b or kind(a) != kind(b)]
            return f"first difference {differing[:4]}", len(ours), seconds
    return None, len(ours), seconds


def main() -> int:
    from verdictflow.session import build_session

    import __spark_entry__ as entry

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session(
        master="local[8]", shuffle_partitions=8,
        extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failures = entry.oracle_sql(), 0
    for name, function in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, rows, seconds = compare(spark, name, function, oracles.get(name), sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            problem, rows, seconds = f"{type(exc).__name__}: {str(exc)[:1500]}", 0, 0.0
        failures += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        twin = "" if name in oracles else " (no twin)"
        print(f"{mark} {name:26} {rows:8d} rows {seconds:6.2f}s{twin} {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main())
