"""Row predicates of text tables, as Columns that Catalyst pushes down and combines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALARM = tuple(sorted("debug exception failed initialized log. patcher postfix prefix steamworks error: warning:".split())) + ("error unknown",)
KEYBOARD = ("mouse", *(f"{side} {name}" for name in ("shift", "ctrl", "alt") for side in ("left", "right")))
SHOUTED = ("EXCEPTION", "WARNING", "FAILED", "UNKNOWN", "ERROR")
NAMESPACES = ("com.", "org.", "system.", "unityengine.")
#: White space as both Java and RE2 read it.
BLANK = r"^[ \t\n\r\f]*$"


def prose_text(c: Column) -> Column:
    """Not empty, and not a technical key (lower-case letters, digits, dot, underscore and hyphen, with a dot)."""
    return F.coalesce((c != "") & ~(c.rlike(r"^[a-z0-9._-]+$") & c.contains(".")), F.lit(False))


def not_placeholder(c: Column) -> Column:
    """Neither one placeholder in braces nor one or two signs."""
    return ~(c.rlike(r"^\{[^}]*\}$") | c.rlike(r"^[^\p{L}\p{N}_]{1,2}$"))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def assembly_text(c: Column) -> Column:
    """Strings of an assembly that a reader might see: all that none of twenty tests of identifiers, paths, logs and keys rejects."""
    low = F.lower(c)
    rejected = [
        c.rlike(BLANK),
        c.contains("_"),
        c.rlike(r"^[A-Z]\p{Alnum}+$"),
        c.rlike(r"^[a-z]+[A-Z]\p{Alnum}*$"),
        (c == low) & (c != F.upper(c)) & ~c.contains(" ") & (F.char_length(c) < 15),
        c.contains(".") & c.rlike(r"^[a-z0-9.\-]+$"),
        c.contains("http://") | c.contains("https://"),
        c.contains("/") & ~c.startswith("http"),
        _any([c.startswith(x) for x in NAMESPACES]),
        c.rlike(r"\{[0-9]+\}"),
        c.contains('("') | c.contains('")'),
        c.contains("!!!"),
        c.rlike(r"\.[A-Z]"),
        _any([low.contains(x) for x in ALARM]),
        low.isin(*KEYBOARD),
        low.endswith(".dll"),
        c.contains(".") & c.rlike(r":[ \t\n\r\f]*$"),
        c.contains("::"),
        c.rlike(r"^\[[0-9]{4}-[0-9]{2}-[0-9]{2}") | c.contains("-->"),
        c.rlike(r"^\p{Alnum}+(?:\.\p{Alnum}+)+$"),
        _upper(c) & c.contains(" ") & _any([c.contains(x) for x in SHOUTED]),
    ]
    return F.coalesce(~_any(rejected), F.lit(False))


def differs(key: Column, text: Column) -> Column:
    return key.cast("string") != text.cast("string")


def within_length(a: Column, b: Column, band: int) -> Column:
    return F.abs(F.char_length(a) - F.char_length(b)) <= band


def active(minute: Column, start: Column, end: Column) -> Column:
    """Minutes of the day from start to end, across midnight where the end comes first; equal ends mean that one minute."""
    return F.when(start <= end, minute.between(start, end)).otherwise((minute >= start) | (minute <= end))


def word_kept(c: Column, stop: list[str]) -> Column:
    """Longer than one character without the spaces around it, and no stop word in any case."""
    return (F.char_length(F.trim(c)) > 1) & ~F.lower(c).isin(*[s.lower() for s in stop])


def overridable(name: Column, allow: str, deny: str) -> Column:
    return name.rlike(allow) & ~name.rlike(deny)


def clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))
