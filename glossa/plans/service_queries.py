"""Queries over lasting caches, keyed stores and indexes built from a specification, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators import caches, relational, search
from glossa.plans.text_queries import Tables, registrar
from glossa.plans.vector_queries import _COS, _V, _topk
from glossa.streaming.runner import shared

QUERIES: dict = {}
ORACLES: dict = {}
_add = registrar(QUERIES, ORACLES)


@_add("cache_read_through", "SELECT doc_id, upper(lang) AS value, coalesce(lang = 'en', false) AS hit FROM documents")
def cache_read_through(t: Tables) -> DataFrame:
    """One key is known beforehand; the others are made once each and written through."""
    c = caches.Cache(t.spark, shared(t.spark, "cache"))
    c.put(t.spark.createDataFrame([("en", "EN")], "key string, value string"))
    out = c.read_through(t.documents.select("doc_id", "lang"), F.col("lang"), lambda missing: missing.select("key", F.upper("key").alias("value")))
    return out.select("doc_id", "value", "hit")


@_add("cache_flush", "SELECT lang AS key, upper(lang) AS value, count(*) * 2 AS uses FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def cache_flush(t: Tables) -> DataFrame:
    """Uses of two rounds, added up when the log is rewritten."""
    c = caches.Cache(t.spark, shared(t.spark, "cache"))
    for _ in range(2):
        c.read_through(t.documents.select("doc_id", "lang"), F.col("lang"), lambda missing: missing.select("key", F.upper("key").alias("value")))
    c.flush()
    return c.rows().select("key", "value", "uses")


@_add("task_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def task_upsert(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type")
    return caches.upserted(e.where("event_type != 'error'"), e.where("event_type = 'error'"), ["user_id"], "event_id")


@_add("index_all_cells", f"WITH {_V} {_topk(_COS)}")
def index_all_cells(t: Tables) -> DataFrame:
    """Trained cells that are all probed give what an exact search gives."""
    return search.build(t.embeddings, search.parse(["ivf", None, {"cells": 8, "nprobe": 8}])).search(t.embeddings, 10)


@_add("index_refined", f"WITH {_V} {_topk(_COS)}")
def index_refined(t: Tables) -> DataFrame:
    return search.build(t.embeddings, search.parse(["refine", "flat", {"factor": 2}])).search(t.embeddings, 10)


@_add("vector_context", f"WITH {_V}, t AS ({_topk(_COS, 3, where='a.vec_id % 2 = 0 AND b.vec_id % 2 = 1')}) SELECT v.vec_id, coalesce(string_agg('s' || t.vec_id || '=t' || t.vec_id, ' ' ORDER BY rank), '') AS context FROM v LEFT JOIN t ON t.query_id = v.vec_id WHERE v.vec_id % 2 = 0 GROUP BY v.vec_id")
def vector_context(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "embedding")
    done = e.where("vec_id % 2 = 1").select("*", F.concat(F.lit("s"), "vec_id").alias("source"), F.concat(F.lit("t"), "vec_id").alias("target"))
    return search.vector_context(e.where("vec_id % 2 = 0"), done, 3).select("vec_id", F.array_join("context", " ").alias("context"))


@_add("reference_split", "SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def reference_split(t: Tables) -> DataFrame:
    known = t.labels.groupBy("doc_id").agg(F.any_value("quality").alias("quality"))
    return relational.cached(t.documents.select("doc_id"), known, "doc_id").select("doc_id", F.coalesce(F.col("quality").cast("long"), F.lit(-1).cast("long")).alias("quality"), "hit")
