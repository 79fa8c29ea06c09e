"""Joins, dictionaries and assembly of keyed text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.names import unused


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in order; an aggregate, so that a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.max(ordered).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min(ordered).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def referenced(entries: DataFrame, reference: DataFrame, key: str, order: list[str]) -> DataFrame:
    """entries with the columns of the reference row of their key; of several such rows the last wins."""
    return entries.join(last_wins(reference, [key], order), key)


def split_known(entries: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known, and the rest (null keys among them)."""
    ids = known.select(key).distinct()
    return entries.join(ids, key, "left_semi"), entries.join(ids, key, "left_anti")


def cached(entries: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """entries with the cache's columns, and hit, which replaces columns of that name. The cache has one row for each key."""
    (mark,) = unused(1, entries, cache)
    plain = lambda t: t.select(*[c for c in t.columns if c.lower() != "hit" or c == key])
    marked = plain(cache).withColumn(mark, F.lit(True))
    return plain(entries).join(marked, key, "left").withColumn("hit", F.coalesce(mark, F.lit(False))).drop(mark)


def rate_text(hits: Column, total: Column) -> Column:
    return F.format_string("%.4f%%", F.when(total > 0, hits * 100.0 / total).otherwise(F.lit(0.0)))


def multimap(pairs: DataFrame, source: str, target: str, order: list[str]) -> DataFrame:
    """(source, targets): all targets of a source in order, repeats kept."""
    rows = pairs.groupBy(source).agg(F.array_sort(F.collect_list(F.struct(*order, target))).alias("_r"))
    return rows.select(source, F.transform("_r", lambda r: r[target]).alias("targets"))


def dense(dictionary: DataFrame, max_len: int) -> DataFrame:
    """(source, text): distinct targets of at most max_len characters in their order, joined by a comma."""
    fit = F.array_distinct(F.filter("targets", lambda t: F.char_length(t) <= max_len))
    return dictionary.select("source", F.array_join(fit, ", ").alias("text"))


def sparse(pairs: DataFrame, max_len: int, order: list[str], reversal: bool = False) -> DataFrame:
    """(source, target): each target once, with the source that has it first in order; with reversal also (target, source)."""
    fit = pairs.where(F.char_length("target") <= max_len).select("source", "target", *order)
    once = first_wins(fit, ["target"], order).select("source", "target")
    return once.unionByName(once.select(F.col("target").alias("source"), F.col("source").alias("target"))) if reversal else once


def merged_dictionaries(first: DataFrame, second: DataFrame) -> DataFrame:
    """(source, targets) of both; targets of the second that the first lacks are appended in their order."""
    both = first.withColumnRenamed("targets", "a").join(second.withColumnRenamed("targets", "b"), "source", "full")
    none = F.array().cast("array<string>")
    return both.select("source", F.array_union(F.coalesce("a", none), F.coalesce("b", none)).alias("targets"))


def merge_update(rows: DataFrame, patch: DataFrame, merged: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value replaced by the patch's, else by merged's, else kept; patch and merged are (key, value) with distinct keys."""
    p = patch.select(F.col(key), F.col(value).alias("_p"))
    m = merged.select(F.col(key), F.col(value).alias("_m"))
    return rows.join(p, key, "left").join(m, key, "left").withColumn(value, F.coalesce("_p", "_m", value)).drop("_p", "_m")


def separate_update(rows: DataFrame, other: DataFrame, key: str, value: str, mode: str = "present") -> DataFrame:
    """mode "present": rows whose key the other table has, with its value; "missing": rows whose key it lacks."""
    if mode == "missing":
        return rows.join(other.select(key).distinct(), key, "left_anti")
    return rows.drop(value).join(other.select(key, value), key)


def looked_up(texts: DataFrame, id_col: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """(id, references): the references (word, reference, ...) of a text's words, in the words' order and then by rank; texts without any are left out."""
    words = texts.select(id_col, F.posexplode(F.split(text_col, r"[ _\-:]+")).alias("_pos", "word")).where("word != ''")
    got = words.join(dictionary, "word").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_pos", "rank", "reference"))).alias("_r"))
    return got.select(id_col, F.transform("_r", lambda r: r["reference"]).alias("references"))


def paired_files(files: DataFrame, source: str, target: str) -> DataFrame:
    """(dir, ext, source_path, target_path): folders (path) that hold source.ext and target.ext in any case; of several extensions json comes before lang, and lang before local."""
    p = files.select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)).alias("stem"),
        F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"),
    ).where(F.col("ext").isin("json", "lang", "local"))
    s = p.where(F.col("stem") == source.lower()).groupBy("dir", "ext").agg(F.min("path").alias("source_path"))
    t = p.where(F.col("stem") == target.lower()).groupBy("dir", "ext").agg(F.min("path").alias("target_path"))
    both = s.join(t, ["dir", "ext"]).withColumn("rank", F.when(F.col("ext") == "json", 0).when(F.col("ext") == "lang", 1).otherwise(2))
    return first_wins(both, ["dir"], ["rank"]).select("dir", "ext", "source_path", "target_path")


def evicted(cache: DataFrame, now: Column, grace: int, least: float, cap: int) -> DataFrame:
    """(key, score) of the entries (key, freq, born) that stay: those in grace or used often enough for their age, at most cap of them, the best first.

    Ties at the cap are broken by key. The cut is a global top-cap that every task reduces first.
    """
    age = now - F.col("born")
    score = F.round(F.col("freq") / (age + 1), 9)
    kept = cache.where((age <= grace) | (F.col("freq") / (age + 1) >= least))
    return kept.select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(cap)


def best_candidate(df: DataFrame, group: str, candidate: str, score: str, position: str) -> DataFrame:
    """(group, candidate, score) with the largest score; the first of equals wins."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(position)).alias("p"), F.col(candidate).alias("c"))).alias("_m")
    return df.groupBy(group).agg(top).select(group, F.col("_m.c").alias(candidate), F.col("_m.s").alias(score))


def previous(df: DataFrame, by: str, order: str, n: int) -> Window:
    return Window.partitionBy(by).orderBy(order).rowsBetween(-n, -1)
