"""Compare the named queries with their SQL counterparts: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(path).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plain(value: object) -> object:
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def normal(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(frame, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs first."""
    result = con.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    theirs = normal(theirs_columns, result.fetchall())
    ours = normal(frame.columns, frame.collect())
    if sorted(frame.columns) != sorted(theirs_columns):
        return f"columns {sorted(frame.columns)} != {sorted(theirs_columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> None:
    from shelfwright.plans.oracle import ORACLES
    from shelfwright.plans.registry import QUERIES
    from tests.conftest import make_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    path = f"/root/testdata/sf{scale}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = make_session(), connect(path), 0
    for name in names:
        started = time.time()
        try:
            frame = QUERIES[name](spark, path)
            if name in ORACLES:
                found = difference(frame, con, ORACLES[name])
            else:
                found = f"no oracle, {frame.count()} rows"
        except Exception as error:  # report every query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{time.time() - started:6.2f}s {name}: {found or 'same'}", flush=True)
    missing = set(ORACLES) - set(QUERIES)
    print(f"{len(names)} queries, {bad} differ; oracles without query: {sorted(missing)}")


if __name__ == "__main__":
    main()
