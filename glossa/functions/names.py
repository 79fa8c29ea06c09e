"""Column names for intermediate results that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(count: int, *tables: DataFrame) -> list[str]:
    """So many names that none of the tables uses, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    out: list[str] = []
    k = 0
    while len(out) < count:
        if (name := f"_x{k}") not in taken:
            out.append(name)
        k += 1
    return out
