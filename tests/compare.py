"""Runs a query and its SQL on the same Parquet tables and compares their rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, canonical(v)) for k, v in value.items())
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def duck(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(canonical(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def compare(spark, query, sql: str, folder: str) -> tuple[bool, str]:
    names, got = rows_of(query(spark, folder))
    result = duck(folder).sql(sql)
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    want = Counter(tuple(canonical(r[i]) for i in order) for r in result.fetchall())
    if names != [result.columns[i] for i in order]:
        return False, f"columns {names} against {[result.columns[i] for i in order]}"
    if got != want:
        return False, f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return True, f"{sum(got.values())} rows"
