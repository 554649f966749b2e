"""Holds a query against its SQL twin on DuckDB: values to nine significant digits, null apart from NaN."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

from castline.bridge import TABLES


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str([_plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(table) -> list[tuple]:
    """Sorted rows of an Arrow table, columns by name."""
    columns = [table.column(n).to_pylist() for n in sorted(table.column_names)]
    return sorted(tuple(map(_plain, r)) for r in zip(*columns, strict=True))


def expected(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).to_arrow_table()


def check(query, sql: str, spark, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toArrow(), expected(sql, sf_dir)
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)
