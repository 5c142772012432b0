"""Run queries next to their statements and compare the rows: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sparkledger.plans import registry  # noqa: E402
from sparkledger.plans.views import TABLES  # noqa: E402


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, (decimal.Decimal, float, int)):
        return round(float(value), 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    """None when equal, else a short account of the difference."""
    started = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - started
    if name not in registry.ORACLES:
        return None, len(got), spent
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), spent
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows vs {len(want)}\n   spark  {only_got}\n   oracle {only_want}", len(got), spent
    return None, len(got), spent


if __name__ == "__main__":
    from sparkledger.session import build_session

    registry.load_all()
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.QUERIES)
    session = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    db = connect(sf)
    bad = 0
    for query_name in names:
        try:
            problem, count, seconds = compare(session, db, sf, query_name)
        except Exception as exc:  # noqa: BLE001
            problem, count, seconds = f"{type(exc).__name__}: {str(exc)[:900]}", 0, 0.0
        bad += problem is not None
        mark = "ok  " if problem is None else "BAD "
        print(f"{mark} {query_name} rows={count} {seconds:.2f}s {'' if query_name in registry.ORACLES else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
