"""Spark rows against the rows of the SQL twin in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    out = [tuple(plain(v) for v in r) for r in zip(*(frame[c].tolist() for c in cols), strict=True)] if len(frame) else []
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def oracle(sql: str, sf: str = SF):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return con.execute(sql).df()


def same(df, sql: str, sf: str = SF) -> None:
    got, want = df.toPandas(), oracle(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
