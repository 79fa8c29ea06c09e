"""Streams over folders of Parquet files that run until all that is there is read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; only a session on one machine may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glossa-")
    return f"{base}/glossa/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """The files of a path (a file or a folder) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-1]}[{name[-1]}]")  # a pattern that only this name meets


def finished(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The result of a streaming plan over all files that are there, each batch written once."""
    out, check = shared(spark, "stream"), shared(spark, "offsets")
    df = plan(source(spark, path))

    def put(batch: DataFrame, number: int) -> None:
        # Named by the batch: one that is run again overwrites itself, and complete results supersede earlier ones.
        batch.write.mode("overwrite").parquet(f"{out}/all" if mode == "complete" else f"{out}/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(out)


def appended(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The table that a stream of rows was appended to."""
    out, check = shared(spark, "table"), shared(spark, "offsets")
    df = source(spark, path).select(*columns)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
