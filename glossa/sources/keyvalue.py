"""Language files of keys and values: .lang, .json, .local and block files, read from folders and written back."""

from __future__ import annotations

import ast
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.decode import decoded


def wanted_line(line: Column) -> Column:
    return line.contains("=") & ~line.startswith("#") & ~line.startswith("//")


def split_pair(line: Column) -> list[Column]:
    """Key and value at the first equals sign; the key keeps its blanks."""
    at = F.instr(line, "=")
    return [F.substring(line, F.lit(1), at - 1).alias("key"), F.substring(line, at + 1, F.char_length(line)).alias("value")]


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("pos", "line"))


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, content) of all files below path, in whatever encoding they are."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select(F.col("path").alias("file"), decoded(F.col("content")).alias("content"))


def lang(files: DataFrame) -> DataFrame:
    """(file, pos, key, value) of .lang contents: lines with "=" that are no comments."""
    rows = _lines(files).where(wanted_line(F.col("line")))
    return rows.select("file", "pos", *split_pair(F.col("line")))


def local(files: DataFrame) -> DataFrame:
    """As lang, without blanks around the sign and without blank lines."""
    rows = _lines(files).where("trim(line) != ''").withColumn("line", F.regexp_replace("line", r"\s*=\s*", "="))
    return rows.where(wanted_line(F.col("line"))).select("file", "pos", *split_pair(F.col("line")))


def language_json(files: DataFrame) -> DataFrame:
    """(file, pos, key, value) of one JSON object for each file; values that aren't strings as text. A file that doesn't parse has no rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, content in zip(part["file"], part["content"], strict=True):
                try:
                    doc = json.loads(content)
                except (TypeError, ValueError):
                    continue
                if isinstance(doc, dict):
                    rows += [(file, i, k, v if isinstance(v, str) else str(v)) for i, (k, v) in enumerate(doc.items())]
            yield pd.DataFrame(rows, columns=["file", "pos", "key", "value"])

    got = files.select("file", "content").mapInPandas(run, "file string, pos int, key string, value string")
    # A key is read from the line "key=value", so it ends at its first sign; comments are no entries.
    line = F.concat("key", F.lit("="), "value")
    return got.where(wanted_line(line)).select("file", "pos", *split_pair(line))


def forge_blocks(files: DataFrame) -> DataFrame:
    """(file, block, kind, key, value) of block files: ``S:"k"=v`` inside ``block {``."""
    lines = _lines(files)
    head = F.regexp_extract("line", r"^\s*([^\s{][^{]*?)\s*\{\s*$", 1)
    tagged = lines.withColumn("_h", F.when(head != "", head))
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tagged.withColumn("block", F.last("_h", ignorenulls=True).over(w)).where(F.col("line").rlike(r'^\s*[A-Z]:(?:"[^"]*"|[^=]*)=') & F.col("_h").isNull())
    pattern = r'^\s*([A-Z]):(?:"([^"]*)"|([^=]*))=(.*)$'
    key = F.coalesce(F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")), F.regexp_extract("line", pattern, 3))
    return rows.select("file", "pos", "block", F.regexp_extract("line", pattern, 1).alias("kind"), key.alias("key"), F.regexp_extract("line", pattern, 4).alias("value"))


def review(files: DataFrame) -> DataFrame:
    """(file, pos, key, source, target) of review files: on each line a literal dictionary of one key and [source, target], or JSON."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, pos, line in zip(part["file"], part["pos"], part["line"], strict=True):
                try:
                    doc = ast.literal_eval(line.strip())
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    continue
                if isinstance(doc, dict):
                    rows += [(file, pos, str(k), str(v[0]), str(v[1])) for k, v in doc.items() if isinstance(v, (list, tuple)) and len(v) == 2]
            yield pd.DataFrame(rows, columns=["file", "pos", "key", "source", "target"])

    return _lines(files).mapInPandas(run, "file string, pos int, key string, source string, target string")


# Writers


def lang_line(key: Column, value: Column) -> Column:
    """key=value on one line: line breaks inside become \\n and \\r, other runs of white space one blank."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.concat(key, F.lit("="), F.regexp_replace(safe, r"\s+", " "))


def local_line(key: Column, value: Column) -> Column:
    return F.concat(F.trim(key), F.lit(" = "), F.trim(value))


def review_line(key: Column, source: Column, target: Column) -> Column:
    """A JSON line that review() reads again."""
    return F.to_json(F.create_map(key, F.array(source, target)))


def joined_lines(rows: DataFrame, line: Column) -> DataFrame:
    """(file, content): a file's lines in order of pos."""
    g = rows.withColumn("_line", line).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "_line"))).alias("r"))
    return g.select("file", F.array_join(F.transform("r", lambda x: x["_line"]), "\n").alias("content"))


def json_contents(rows: DataFrame) -> DataFrame:
    """(file, content): one JSON object for each file; the last of repeated keys wins, and values that are JSON lists or objects stay so."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        doc = {}
        for k, v in part.sort_values("pos")[["key", "value"]].itertuples(index=False):
            doc.pop(k, None)
            doc[k] = _parsed(v)
        return pd.DataFrame({"file": [key[0]], "content": [json.dumps(doc, ensure_ascii=False, indent=4)]})

    return rows.select("file", "pos", "key", "value").groupBy("file").applyInPandas(run, "file string, content string")


def _parsed(v: str | None):
    if isinstance(v, str) and v[:1] in ("[", "{"):
        for read in (json.loads, ast.literal_eval):
            try:
                got = read(v)
            except (ValueError, SyntaxError):
                continue
            if isinstance(got, (list, dict)):
                return got
    return v


def write_texts(contents: DataFrame, path: str, root: str | None = None) -> list[str]:
    """One text file for each row (file, content) below path, which any file system of Spark may hold; returns the files' relative paths.

    Files keep their folders: the part of file after root or, where that isn't given and files are absolute, after the folder that all of
    them share. Tasks write into a temporary folder of path, and each file is then renamed to its place, so that a task that runs
    again leaves nothing behind. A file ends with a line break; of repeated names one stays; null names are left out; names that
    lead out of path are an error.
    """
    spark = contents.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    work = at(path, f"_writing-{uuid.uuid4().hex}")
    fs = work.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = contents.where("file is not null").groupBy(F.col("file").alias("_file")).agg(F.max(F.coalesce("content", F.lit(""))).alias("value"))
    rows.select("value", "_file").write.partitionBy("_file").text(work.toString())
    made = {unquote(x.getPath().getName()[len("_file=") :]): x.getPath() for x in fs.listStatus(work) if x.isDirectory()}
    plain = {name: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "", name) for name in made}
    if root is not None:
        base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "", root).rstrip("/") + "/"
        plain = {k: v.removeprefix(base) for k, v in plain.items()}
    elif plain and all(v.startswith("/") for v in plain.values()):
        shared = posixpath.commonpath([posixpath.dirname(v) for v in plain.values()])
        plain = {k: posixpath.relpath(v, shared) for k, v in plain.items()}
    out = []
    for name, folder in sorted(made.items()):
        place = posixpath.normpath(plain[name].lstrip("/"))
        if place in ("", ".") or place.split("/")[0] == "..":
            raise ValueError(f"not a file below the folder: {name}")
        goal = at(path, place)
        fs.mkdirs(goal.getParent())
        fs.delete(goal, False)
        part = next(x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
        if not fs.rename(part, goal):
            raise OSError(f"can't write {goal}")
        out.append(place)
    fs.delete(work, True)
    return out
