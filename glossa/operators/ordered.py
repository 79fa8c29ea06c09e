"""Positions, running sums and batches over ordered rows, without putting a whole group in one task.

Rows are cut into buckets of the order column's value range; one number for each bucket is added up over the buckets before it
(a small table), and windows run inside the buckets only. A hot group is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.names import unused

WIDTH = 1 << 16


def running(df: DataFrame, by: list[str], order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the sum of value over the rows of the same ``by`` up to this one in the order of an integer column, distinct within ``by``; null values count as 0.

    Columns of df may have any names; one that is called as the result is replaced.
    """
    v, b, part, base = unused(4, df)
    keep = [c for c in df.columns if c.lower() != name.lower() or c in by or c == order]
    d = df.withColumn(v, F.coalesce(value, F.lit(0)).cast("long")).withColumn(b, F.floor(F.col(order) / width)).select(*keep, v, b)
    sums = d.groupBy(*by, b).agg(F.sum(v).alias(part))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, b, F.coalesce(F.sum(part).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*by, b).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = d.alias("d").join(bases.alias("s"), [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, b)])
    return joined.select(*[F.col(f"d.{c}") for c in (*keep, b, v)], base).withColumn(name, (F.col(base) + F.sum(v).over(inside)).cast("long")).drop(b, v, base)


def positioned(df: DataFrame, by: list[str], order: str, name: str = "position", width: int = WIDTH) -> DataFrame:
    """df with the row's 0-based position within ``by``."""
    return running(df, by, order, F.lit(1), name, width).withColumn(name, F.col(name) - 1)


def balanced_batches(df: DataFrame, by: list[str], order: str, size: float) -> DataFrame:
    """df with batch (0-based): round(n / size) batches (half to even, at least one) whose sizes differ by at most one, the larger ones spread evenly.

    Batch g begins at row floor(g * n / batches), so a row's batch is a closed form of its position.
    """
    n, g = unused(2, df)
    counts = df.groupBy(*by).agg(F.count("*").alias(n))
    counts = counts.withColumn(g, F.greatest(F.lit(1), F.rint(F.col(n) / F.lit(size)).cast("long")))
    p = positioned(df, by, order)
    joined = p.alias("p").join(counts.alias("c"), [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by])
    batch = F.expr(f"((p.position + 1) * {g} + {n} - 1) div {n} - 1")
    return joined.select(*[F.col(f"p.{c}") for c in df.columns if c.lower() not in ("position", "batch")], F.col("p.position"), batch.alias("batch"))


def within_budget(df: DataFrame, by: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """The leading rows of each group whose sizes add up to the budget at most, with the running sum as ``used``."""
    return running(df, by, order, size, "used").where(F.col("used") <= budget)


def greedy(sizes: np.ndarray, budget: int, cur: int = 0, group: int = 0) -> tuple[np.ndarray, int, int]:
    """Group numbers of items packed in order, and the size and number of the group that stays open; a new group begins when an item would exceed the budget."""
    out = np.empty(len(sizes), np.int64)
    ends = np.cumsum(sizes, dtype=np.int64)
    i, n = 0, len(sizes)
    while i < n:
        done = ends[i - 1] if i else 0
        j = int(np.searchsorted(ends, done + budget - cur, side="right"))
        if j > i:
            out[i:j] = group
            cur += int(ends[j - 1] - done)
            i = j
        else:
            # Not even this item fits: a new group, in which an item longer than the budget stands alone.
            group += 1
            cur = int(sizes[i])
            out[i] = group
            i += 1
    return out, cur, group


def greedy_batches(df: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """(by, order, size, batch): rows of each group packed in order under a budget, as a stream over sorted partitions that holds one batch of rows at a time.

    A first item that is longer than the budget leaves batch 0 empty. A null size counts as 0.
    """
    lean = df.select(F.col(by).cast("string").alias("by"), F.col(order).cast("long").alias("order"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), (0, 0)
        for b in batches:
            keys, sizes = b.column("by").to_pylist(), b.column("size").to_numpy()
            out = np.empty(len(keys), np.int64)
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != last:
                    last, state = keys[i], (0, 0)
                out[i:j], *rest = greedy(sizes[i:j], budget, *state)
                state = tuple(rest)
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], ["by", "order", "size", "batch"])

    packed = lean.repartition("by").sortWithinPartitions("by", "order").mapInArrow(run, "by string, `order` long, size long, batch long")
    return packed.select(F.col("by").alias(by), F.col("order").alias(order), "size", "batch")
