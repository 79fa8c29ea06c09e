"""Connected components and removal by id, shared by the deduplicating operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of edges (a, b): root is the smallest id that it is connected with, the root's own row included.

    Alternating large-star and small-star rounds, each written to the shared folder; a component of n nodes needs O(log n)
    rounds whatever its shape. A node's least neighbour is an aggregate, combined before the shuffle, that is joined back, so that no
    task need hold a component or all edges of a hub (adaptive execution splits the hub's share of the join).
    """
    spark = edges.sparkSession

    def least(e: DataFrame) -> DataFrame:
        """e (u, v) with m, the least neighbour of u or u itself."""
        m = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("_u", "m").alias("m"))
        return e.join(m, F.col("u") == F.col("_u")).select("u", "v", "m")

    cur, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    state = None
    while True:
        both = cur.union(cur.select("v", "u"))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        nxt, nxt_path = written(small, "cc")
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, path)
        cur, path, before, state = nxt, nxt_path, state, tuple(row)
        if state == before:
            break
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


#: Up to so many ids (8 bytes each) are broadcast to filter by; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids (one column, distinct); rows with a null doc_id stay.

    Up to BROADCAST_IDS ids are broadcast, more are joined by a shuffle; the rows are the same.
    """
    name = next(c for c in docs.columns if c.lower() == "doc_id")
    other = next(c for c in ("gone", *(f"gone{i}" for i in range(len(docs.columns)))) if c not in [x.lower() for x in docs.columns])
    right = ids.select(F.col(ids.columns[0]).alias(other))
    if right.count() <= BROADCAST_IDS:
        right = F.broadcast(right)
    return docs.join(right, F.col(f"`{name}`") == F.col(other), "left_anti")
