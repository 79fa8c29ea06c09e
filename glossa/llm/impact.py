"""Exact top-k search with an impact-ordered index, score at a time.

The index holds, for each shard of documents and each term, the postings by descending quantised impact (the term-frequency part
of BM25, rounded up to one of 63 levels). A query processes the segments (runs of one term and one level) of all its terms by
descending idf * level and stops only when the bounds prove that no other document can be among the k best; the
possible members are then scored exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import scratch


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    levels: int = 63
    #: Documents and bytes of text in a shard, at most.
    shard_docs: int = 16384
    shard_bytes: int = 24 << 20
    #: Distinct terms of the queries that are searched at once; more queries are searched in further passes.
    pass_terms: int = 200_000


def _lens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs with their frequency, and the lengths of the texts."""
    texts, terms, tfs, sizes = [], [], [], np.zeros(len(column), np.int64)
    for i, j in tv.chunks(column):
        t = tv.tokenize(column.slice(i, j - i))
        sizes[i:j] = t.counts
        order = np.lexsort((t.hashes, t.text_of))
        text, term = t.text_of[order], t.hashes[order]
        first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (term[1:] != term[:-1])))) if len(text) else np.zeros(0, np.int64)
        texts.append(text[first] + i)
        terms.append(term[first])
        tfs.append(np.diff(np.append(first, len(text))))
    if not texts:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, sizes
    return np.concatenate(texts), np.concatenate(terms), np.concatenate(tfs), sizes


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array whose items are slices (of elements) of values."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def build(docs: DataFrame, path: str, mean_length: float, p: SearchParams) -> None:
    """Write the index: rows (shard, term, docs, tfs, levels), and for each shard one row with term null that holds doc_ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, made = TaskContext.get().partitionId(), 0
        for b in batches:
            column = tv.strings(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            for i, j in tv.chunks(column, p.shard_bytes):
                for a in range(i, j, p.shard_docs):
                    z = min(j, a + p.shard_docs)
                    text, term, tf, sizes = _lens(column.slice(a, z - a))
                    part = tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * sizes[text] / mean_length))
                    level = np.clip(np.ceil(part / (p.k1 + 1) * p.levels - 1e-9), 1, p.levels).astype(np.uint8)
                    order = np.lexsort((text, -level.astype(np.int16), term))
                    text, term, tf, level = text[order], term[order], tf[order], level[order]
                    first = tv.starts_of(term)
                    offsets = np.append(first, len(term))
                    # Named by partition and ordinal: a task that runs again writes the same names.
                    shard, made = (part_id << 32) | made, made + 1
                    n = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, shard)), pa.array(np.append(term[first], np.uint64(0)).view(np.int64), mask=np.arange(n + 1) == n), _concat(_binary(text.astype(np.uint16), offsets), ids[a:z].astype(np.int64)), _concat(_binary(tf.astype(np.uint32), offsets), sizes.astype(np.int64)), _concat(_binary(level, offsets), np.zeros(0, np.uint8))], ["shard", "term", "docs", "tfs", "levels"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    d.mapInArrow(run, "shard long, term long, docs binary, tfs binary, levels binary").write.parquet(path)


def _concat(a: pa.Array, last: np.ndarray) -> pa.Array:
    return pa.concat_arrays([a, pa.array([last.tobytes()], pa.binary())])


def search_shard(queries: list[tuple[np.ndarray, np.ndarray]], postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: np.ndarray, ids: np.ndarray, idf: np.ndarray, mean_length: float, p: SearchParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best (documents' indices, exact scores) of each query (term indices, frequencies) in one shard."""
    unit = (p.k1 + 1) / p.levels
    norm = p.k1 * (1 - p.b + p.b * sizes / mean_length)
    cuts = {}
    for t, (_, _, level) in postings.items():
        at = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1], [True])))
        cuts[t] = at, level[at[:-1]].astype(float)
    out = []
    low, high, mask = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    for terms, freq in queries:
        have = [(t, idf[t] * f) for t, f in zip(terms.tolist(), freq.tolist(), strict=True) if t in postings]
        low[:], high[:] = 0, 0
        # The next segment of each term; rest is the most that the segments not yet processed can add to a document.
        heap = [(-w * cuts[t][1][0], t, 0, w) for t, w in have]
        heapq.heapify(heap)
        rest = sum(-x[0] for x in heap) * unit
        done = 0
        while heap:
            bound, t, s, w = heapq.heappop(heap)
            at, lev = cuts[t]
            docs = postings[t][0][at[s] : at[s + 1]]
            high[docs] += w * unit * lev[s]
            low[docs] += w * unit * (lev[s] - 1)
            rest += bound * unit
            if s + 1 < len(lev):
                heapq.heappush(heap, (-w * lev[s + 1], t, s + 1, w))
                rest += w * unit * lev[s + 1]
            done += 1
            if done % 16 == 0 and len(low) > p.k:
                theta = np.partition(low, -p.k)[-p.k]
                # Proof: a document without any processed posting can't reach the k-th best lower bound, nor can most others.
                if rest < theta and np.count_nonzero(high + rest >= theta) <= 4 * p.k:
                    break
        theta = np.partition(low, -p.k)[-p.k] if len(low) > p.k else 0.0
        some = np.flatnonzero((high + max(rest, 0.0) >= theta - 1e-9) & (high > 0))
        exact = np.zeros(len(some))
        if len(some):
            mask[:] = False
            mask[some] = True
            place = np.zeros(len(sizes), np.int64)
            place[some] = np.arange(len(some))
            for t, w in sorted(have):
                docs, tf, _ = postings[t]
                hit = mask[docs]
                d, f = docs[hit], tf[hit]
                exact[place[d]] += w * f * (p.k1 + 1) / (f + norm[d])
        best = np.lexsort((ids[some], -np.round(exact, 9)))[: p.k]
        out.append((some[best], exact[best]))
    return out


def top_k(queries: DataFrame, docs: DataFrame, p: SearchParams = SearchParams(), id_col: str = "item_id") -> DataFrame:
    """(id, rank, doc_id, score): for every row of queries (id, text) its k best rows of docs by BM25, exactly.

    Ties are broken by doc_id (scores that agree to nine places are ties). Only documents with a term of the query are returned, so
    a null, empty or unmatched query has no rows. Null texts of docs count as empty documents, rows with a null doc_id are left
    out, repeated rows are documents of their own. Repeated queries each get their results; a null id is kept. Other columns
    are not read.
    """
    spark = queries.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    kind = queries.schema[id_col].dataType.simpleString()
    asked = queries.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-int(size) // (8 * p.pass_terms)))
    path, parts, totals = scratch(spark, "impacts"), [], None
    for k in range(passes):
        rows = (asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k) if passes > 1 else asked).toArrow()
        t = tv.tokenize(tv.strings(rows.column("text")))
        terms = np.unique(t.hashes)
        index = np.searchsorted(terms, t.hashes)
        asked_terms = []
        for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True):
            asked_terms.append(np.unique(index[a:b], return_counts=True))
        shared_terms = spark.sparkContext.broadcast(terms)

        def stats(batches: Iterator[pa.RecordBatch], shared_terms=shared_terms) -> Iterator[pa.RecordBatch]:
            known = shared_terms.value
            df, n, words = np.zeros(len(known), np.int64), 0, 0
            for b in batches:
                column = tv.strings(b.column("text"))
                n += len(column)
                for i, j in tv.chunks(column):
                    x = tv.tokenize(column.slice(i, j - i))
                    words += len(x.hashes)
                    if len(known) and len(x.hashes):
                        slot = np.minimum(np.searchsorted(known, x.hashes), len(known) - 1)
                        hit = known[slot] == x.hashes
                        pair = np.unique(x.text_of[hit] * len(known) + slot[hit])
                        df += np.bincount(pair % len(known), minlength=len(known))
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((df[some], [n, words])))], ["term", "n"])

        got = {r[0]: r[1] for r in d.select("text").mapInArrow(stats, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
        n_docs, words = got.get(-1, 0), got.get(-2, 0)
        mean_length = words / n_docs if words else 1.0
        df = np.array([got.get(i, 0) for i in range(len(terms))], float)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        if totals is None:
            build(d, path, mean_length, p)
            totals = n_docs, words
        index_df = spark.read.schema("shard long, term long, docs binary, tfs binary, levels binary").parquet(path)
        wanted = spark.createDataFrame(pa.table({"want": pa.array(terms.view(np.int64))}))
        needed = index_df.join(F.broadcast(wanted), F.col("term") == F.col("want"), "left_semi").unionByName(index_df.where("term is null"))
        shared = spark.sparkContext.broadcast((terms, asked_terms, idf, mean_length))

        def search(batch: pa.Table) -> pa.Table:
            terms, asked_terms, idf, mean_length = shared.value
            postings, ids, sizes = {}, None, None
            for term, a, b, c in zip(batch.column("term").to_pylist(), batch.column("docs").to_pylist(), batch.column("tfs").to_pylist(), batch.column("levels").to_pylist(), strict=True):
                if term is None:
                    ids, sizes = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                else:
                    postings[int(np.searchsorted(terms, np.int64(term).view(np.uint64)))] = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint32).astype(float), np.frombuffer(c, np.uint8)
            found = search_shard(asked_terms, postings, sizes, ids, idf, mean_length, p)
            q = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            at = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
            return pa.table({"q": pa.array(q.astype(np.int32)), "doc_id": pa.array(ids[at.astype(np.int64)]), "score": pa.array(np.concatenate([x[1] for x in found]) if found else np.zeros(0))})

        local = needed.groupBy("shard").applyInArrow(search, "q int, doc_id long, score double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "doc_id"))
        best = local.withColumn("rank", rank.cast("long")).where(F.col("rank") <= p.k)
        names = spark.createDataFrame(pa.table({"q": pa.array(range(rows.num_rows), pa.int32()), "id": rows.column("id").combine_chunks()}))
        parts.append(best.join(names, "q").select(F.col("id").cast(kind).alias(id_col), "rank", "doc_id", F.round("score", 6).alias("score")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS mean FROM d),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w)::DOUBLE AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) ORDER BY term) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score
FROM r QUALIFY rank <= 10
"""
