"""Bytes to text where the encoding isn't known."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ENCODINGS = ("utf-8-sig", "gb18030", "utf-16")


def decode_any(data: bytes | None) -> str | None:
    """The first encoding that fits; a UTF-16 mark comes first, and bytes that fit none are kept as Latin-1."""
    if data is None:
        return None
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        try:
            return data.decode("utf-16")
        except UnicodeDecodeError:
            pass
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def decoded(c: Column) -> Column:
    """As decode_any, in Arrow batches."""

    @F.pandas_udf(StringType())
    def slow(x: pd.Series) -> pd.Series:
        return x.map(decode_any)

    return slow(c)


def escaped(text: str) -> str:
    """Characters beyond ASCII as \\uXXXX (surrogate pairs where needed)."""
    return "".join(ch if ord(ch) < 128 else "".join(f"\\u{u:04x}" for u in _units(ch)) for ch in text)


def _units(ch: str) -> list[int]:
    b = ch.encode("utf-16-be", "surrogatepass")
    return [int.from_bytes(b[i : i + 2]) for i in range(0, len(b), 2)]


def unescaped(text: str) -> str:
    """\\uXXXX as characters; anything else stays."""
    import re

    out = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
