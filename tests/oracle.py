"""Spark results against DuckDB over the same tables: row counts, column types and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _family(kind: str) -> str:
    kind = kind.lower()
    for name, starts in {"int": ("bigint", "int", "long", "smallint", "hugeint"), "float": ("double", "float", "decimal"), "text": ("string", "varchar"), "bool": ("bool",), "time": ("timestamp",)}.items():
        if kind.startswith(starts) and not kind.endswith("]"):
            return name
    return kind


def differences(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty where both agree."""
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    kinds = {x[0]: _family(str(x[1])) for x in cur.description}
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours_kinds = {k: _family(v) for k, v in df.dtypes}
    if any(ours_kinds[c] != kinds[c] for c in names):
        return f"types {dict(df.dtypes)} and {[(x[0], str(x[1])) for x in cur.description]}"
    ours = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    a, b = (sorted((tuple(_plain(v) for v in r) for r in rows), key=repr) for rows in (ours, theirs))
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only ours {sorted(set(a) - set(b), key=repr)[:2]}; only theirs {sorted(set(b) - set(a), key=repr)[:2]}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{x!r:.600} and {y!r:.600}"
    return ""
