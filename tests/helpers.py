"""Comparison of a query's rows with DuckDB's for the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        at = p / "*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) > 1 << 62 else str(v)
    return str(v)


def rows_of(table) -> tuple[list[str], list]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(map(str, zip(*[[cell(v) for v in c] for c in cols])))


def same_rows(df, sql: str, sf_dir: str) -> None:
    got, want = rows_of(df.toArrow()), rows_of(duck(sf_dir).execute(sql).to_arrow_table())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    off = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    assert not off, (len(off), off[:3])
