"""Shared storage and loading for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) is a folder made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_glossa_scratch", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = spark._glossa_scratch = "file://" + tempfile.mkdtemp(prefix="glossa-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base}/glossa/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder: lineage is cut, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system after each batch and at the task's end: workers live on, and the next task may be another operator's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it

        def give_back() -> None:
            pa.default_memory_pool().release_unused()
            if trim is not None:
                trim(0)

        try:
            for out in run(batches):
                yield out
                del out
                give_back()
        finally:
            gc.collect()
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
