"""From a folder of documents of any known format to the same folder with other texts: read, filter, apply, write back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.sources import documents, keyvalue

#: Formats that can be written back, by the name that a file's detection gives.
KINDS = ("quest_snbt", "menu_blocks", "mod_json", "game_json", "data_pack", "script", "mod_text")
#: Key-value files: reader and line.
LINES: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[Column, Column], Column]]] = {
    "lang": (keyvalue.lang, keyvalue.lang_line),
    "local": (keyvalue.local, keyvalue.local_line),
}


def with_kinds(files: DataFrame) -> DataFrame:
    """files (file, content) with kind: a format's name, the ending of a key-value file, or null."""

    @F.pandas_udf("string")
    def kind(file: pd.Series, content: pd.Series) -> pd.Series:
        out = []
        for f, c in zip(file, content, strict=True):
            found = documents.detected(f, c) if c is not None else None
            out.append(f.rsplit(".", 1)[-1].lower() if found == "language" else found)
        return pd.Series(out, dtype=object)

    return files.select("file", "content", kind("file", "content").alias("kind"))


def texts_of(files: DataFrame, kept: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, kind, pos, path, text) of all files (file, content, kind); files that can't be read, and texts that ``kept`` refuses, give no rows."""
    parts = []
    for k in KINDS:
        parts.append(documents.extracted(files.where(F.col("kind") == k), k).where("error is null").select("file", F.lit(k).alias("kind"), "pos", "path", "text"))
    for k, (read, _) in LINES.items():
        parts.append(read(files.where(F.col("kind") == k)).select("file", F.lit(k).alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("key").alias("path"), F.col("value").alias("text")))
    parts.append(keyvalue.language_json(files.where(F.col("kind") == "json")).select("file", F.lit("json").alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("key").alias("path"), F.col("value").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if kept is None else out.where(kept(F.col("text")))


def with_texts(files: DataFrame, answers: DataFrame) -> DataFrame:
    """(file, content) of the files that have answers (file, path, text), which take the place of the texts there; others keep theirs."""
    done = answers.select("file", "path", "text")
    named = files.join(done.select("file").distinct(), "file", "left_semi")
    parts = [documents.rewritten(named.where(F.col("kind") == k), done, k) for k in KINDS]
    one = done.groupBy("file", F.col("path").alias("key")).agg(F.min("text").alias("new"))

    def filled(rows: DataFrame) -> DataFrame:
        return rows.join(one, ["file", "key"], "left").select("file", "pos", "key", F.coalesce("new", "value").alias("value"))

    for k, (read, line) in LINES.items():
        parts.append(keyvalue.joined_lines(filled(read(named.where(F.col("kind") == k))), line(F.col("key"), F.col("value"))))
    parts.append(keyvalue.json_contents(filled(keyvalue.language_json(named.where(F.col("kind") == "json")))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run(spark: SparkSession, path: str, out: str, apply: Callable[[DataFrame], DataFrame], kept: Callable[[Column], Column] | None = None, known: DataFrame | None = None) -> list[str]:
    """Read all files below path, ``apply`` rows (file, kind, pos, path, text) -> (file, path, text), and write the files that changed below out.

    known (text, answer), a dictionary, answers the texts that it has; only the others go to ``apply``. Returns the files' relative paths.
    """
    files = with_kinds(keyvalue.texts(spark, path))
    rows = texts_of(files, kept)
    if known is None:
        answers = apply(rows)
    else:
        have = known.groupBy("text").agg(F.min("answer").alias("answer"))
        answers = rows.join(have, "text").select("file", "path", F.col("answer").alias("text"))
        answers = answers.unionByName(apply(rows.join(have, "text", "left_anti").select("file", "kind", "pos", "path", "text")).select("file", "path", "text"))
    return keyvalue.write_texts(with_texts(files, answers), out, path if "://" in path or path.startswith("/") else None)


def reference_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, path, source, target): texts (file, path, text) of the source language with those of the target at the same place, where there are any.

    Files answer to each other by their folder, whatever language their own name says.
    """
    folder = F.regexp_replace("file", r"[^/]*$", "")
    s = sources.select("file", folder.alias("_d"), "path", F.col("text").alias("source"))
    t = targets.groupBy(folder.alias("_d"), "path").agg(F.min("text").alias("target"))
    return s.join(t, ["_d", "path"], "left").select("file", "path", "source", "target")
