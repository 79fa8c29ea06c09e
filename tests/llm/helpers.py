"""Fixtures that every operator must bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves; they must not mind a table that has them too.
CLASHES = ("_id", "_gone", "rep", "h", "g", "k", "rank", "rate", "copy", "keep", "quality", "toxic", "tokens", "digest", "group_id", "src", "term", "score", "_rate", "copies", "_h", "_b", "c0", "c1", "gone", "_u")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return doc_id, text, lang, source, len(text) if text is not None else None


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, signs only, a very long text, ties and repeated rows."""
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "!!! ???"), row(None, prose(1, 30)), row(None, None), row(5, prose(2, 60_000)), row(6, prose(3, 40), None, None), row(7, prose(3, 40)), row(7, prose(3, 40)), row(8, "é ß 漢字 \U0001f600 Ünïcode"), (None, None, None, None, None), row(9, "one")]
    return rows


def table(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *(f"'x' as `{c}`" for c in CLASHES)) if clash else df


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
