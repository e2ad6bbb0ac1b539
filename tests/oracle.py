"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if pd.isna(v):
                cells.append("null")
            elif isinstance(v, float):
                cells.append(repr(round(v, 9) + 0.0))
            elif hasattr(v, "item"):
                v = v.item()
                cells.append(repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v))
            else:
                cells.append(repr(v))
        out.append(tuple(cells))
    return sorted(out)


def run_sql(sql: str, sf: str):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.sql(sql).df()
