"""Lasting caches and keyed stores as Parquet folders: read-through and write-through, flushing, upserts, age limits.

A cache is a log of rows (key, value, uses, at): writers only append, so several may write at the same time, and readers take each key's
latest value and the sum of its uses. Flushing rewrites the log as one row for each key in a new generation; a reader sees either
the old or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cache:
    """Values of one type by a text key below a folder that all executors share."""

    spark: SparkSession
    path: str
    value_type: str = "string"

    def _schema(self) -> str:
        return f"key string, value {self.value_type}, uses long, at timestamp"

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _generations(self) -> list[int]:
        """Complete generations: a rewrite counts once it has been renamed to its place."""
        fs, root = self._fs(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        return sorted(int(x.getPath().getName()[4:]) for x in fs.listStatus(root) if x.getPath().getName().startswith("gen-"))

    def _log(self) -> str:
        made = self._generations()
        return f"{self.path}/gen-{made[-1] if made else 0}"

    def rows(self) -> DataFrame:
        """(key, value, uses, at): the latest value of each key, how often it was used, and when it was first written."""
        if not self._generations():
            return self.spark.createDataFrame([], self._schema())
        log = self.spark.read.schema(self._schema()).parquet(self._log())
        g = log.groupBy("key").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("value"), F.sum("uses").alias("uses"), F.min("at").alias("at"))
        return g.where("value is not null")

    def put(self, entries: DataFrame, now: Column | None = None) -> None:
        """Write (key, value) rows through; later ones supersede earlier ones. Null keys and values are left out."""
        stamp = F.current_timestamp() if now is None else now
        new = entries.where("key is not null and value is not null").select("key", F.col("value").cast(self.value_type).alias("value"), F.lit(0).cast("long").alias("uses"), stamp.alias("at"))
        new.write.mode("append").parquet(self._log())

    def read_through(self, rows: DataFrame, key: Column, make: Callable[[DataFrame], DataFrame], now: Column | None = None) -> DataFrame:
        """rows with value and hit. Distinct missing keys go once through ``make`` ((key) rows -> (key, value) rows) and are written through; uses are counted.

        Rows whose key is null, or that ``make`` gives no value for, have a null value; such keys are tried again the next time. Columns of
        rows that are called key, value or hit are replaced.
        """
        stamp = F.current_timestamp() if now is None else now
        base = rows.withColumn("key", key.cast("string"))
        asked = base.where("key is not null").groupBy("key").agg(F.count("*").alias("uses"))
        known = self.rows().select("key")
        before = f"{self.path}/asked-{uuid.uuid4().hex}"
        asked.join(known.withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).write.parquet(before)
        marked = self.spark.read.schema("key string, uses long, hit boolean").parquet(before)
        self.put(make(marked.where("not hit").select("key")), now)
        used = marked.select("key", F.lit(None).cast(self.value_type).alias("value"), "uses", stamp.alias("at"))
        used.write.mode("append").parquet(self._log())
        plain = base.select(*[c for c in base.columns if c.lower() not in ("value", "hit")])
        out = plain.join(self.rows().select("key", "value"), "key", "left").join(marked.select("key", "hit"), "key", "left")
        return out.withColumn("hit", F.coalesce("hit", F.lit(False)))

    def flush(self, keep: Column | None = None) -> int:
        """Rewrite the log as one row for each key, those for which ``keep`` (of key, value, uses, at) doesn't hold left out; returns the generation."""
        made = self._generations()
        if not made:
            return 0
        rows = self.rows() if keep is None else self.rows().where(keep)
        work, goal = f"new-{uuid.uuid4().hex}", made[-1] + 1
        rows.write.parquet(f"{self.path}/{work}")
        fs = self._fs()
        if not fs.rename(self._path(work), self._path(f"gen-{goal}")):
            raise OSError(f"can't write generation {goal} of {self.path}")
        for old in made[:-1]:  # the last but one stays for plans that still read it
            fs.delete(self._path(f"gen-{old}"), True)
        return goal


def upserted(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """table with changes inserted or, where the key exists, put in place of its row: of all rows of a key the one of the largest ``order``.

    Of equal ones a change wins over a row of the table. Null keys are keys. One aggregation, combined before the shuffle.
    """
    both = table.select("*", F.lit(0).alias("_side")).unionByName(changes.select(*table.columns, F.lit(1).alias("_side")))
    g = both.groupBy(*key).agg(F.max_by(F.struct(*table.columns), F.struct(order, "_side")).alias("_row"))
    return g.select("_row.*").select(*table.columns)


def within_age(table: DataFrame, at: str, now: Column, hours: float) -> DataFrame:
    """Rows that aren't older than so many hours; those without a time are."""
    return table.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) <= F.lit(int(hours * 3_600_000_000)))
