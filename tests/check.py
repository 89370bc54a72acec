"""Compare every query with its SQL twin: ``python tests/check.py [sf] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from linkloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def bag(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, con, name: str, sf_dir: str) -> str:
    """Empty when both engines agree on columns and rows."""
    got = contract.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "" if rows else "no rows"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} / {sorted(columns)}"
    ours, theirs = bag(got.columns, rows), bag(columns, want)
    if ours != theirs:
        return f"rows {len(rows)}/{len(want)} ours {list((ours - theirs))[:2]} theirs {list((theirs - ours))[:2]}"
    return "" if rows else "no rows on either side"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    session = build_session("check")
    session.sparkContext.setLogLevel("ERROR")
    engine = duck(folder)
    for query in sys.argv[2:] or contract.queries():
        started = time.time()
        try:
            problem = difference(session, engine, query, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if not problem else 'BAD'} {query} {time.time() - started:.1f}s {problem}", flush=True)
