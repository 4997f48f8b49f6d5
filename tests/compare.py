"""Holds a query against its SQL in DuckDB, over the same files."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = os.environ.get("TEXTLAKE_TESTDATA", "/root/testdata")


def _plain(x):  # noqa: ANN001, ANN202
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, list | tuple):
        return tuple(map(_plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    try:
        return float(x) if not isinstance(x, str) and hasattr(x, "__float__") else x
    except (TypeError, ValueError):
        return x


def rows_of(df) -> tuple[list[str], Counter]:  # noqa: ANN001
    """Columns in order of name, and the rows with how often each stands."""
    cols = sorted(df.columns)
    return cols, Counter(tuple(map(_plain, (r[c] for c in cols))) for r in df.collect())


def sql_rows(sql: str, directory: str) -> tuple[list[str], Counter]:
    """The same of a DuckDB query."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    done = con.execute(sql)
    names = [x[0] for x in done.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, Counter(tuple(_plain(r[i]) for i in at) for r in done.fetchall())
