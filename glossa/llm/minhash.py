"""Near-duplicate groups by min-max hashing.

Each of 64 permutations of a document's word shingles gives two signature values, its minimum and its maximum, so 128 values
cost 64 hash evaluations for each shingle. The share of equal values is an unbiased estimate of the Jaccard similarity.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import dropped, lean, written
from .graph import components, without


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 3
    permutations: int = 64
    #: Signature values in a band; bands as many as whole ones fit (32).
    rows_per_band: int = 4
    #: Least share of equal signature values.
    threshold: float = 0.6
    #: Documents of a bucket that are held at once; larger buckets are compared block with block.
    block: int = 1024
    seed: int = 7


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and their offsets; a text of fewer than n words is one shingle, one without words has none."""
    t = tv.tokenize(column)
    h, at = tv.ngrams(t, n)
    counts = np.maximum(t.counts - n + 1, 0)
    short = np.flatnonzero((t.counts > 0) & (t.counts < n))
    if len(short):
        whole = []
        for i in short:
            x = np.zeros(1, np.uint64)
            for k in range(t.offsets[i], t.offsets[i + 1]):
                x = tv.mix(x * np.uint64(0x2545F4914F6CDD1D) + t.hashes[k : k + 1])
            whole.append(x[0])
        offsets = np.concatenate(([0], np.cumsum(counts)))
        h = np.insert(h, offsets[short], np.array(whole, np.uint64))
        counts[short] = 1
    return h, np.concatenate(([0], np.cumsum(counts)))


def signatures(column: pa.Array, p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """(texts x 2 permutations) uint16 values, minimum and maximum by turns, and how many shingles each text has."""
    rng = np.random.default_rng(p.seed)
    a = (rng.integers(0, 2**32, p.permutations, np.uint64) | 1).astype(np.uint32)
    b = rng.integers(0, 2**32, p.permutations, np.uint64).astype(np.uint32)
    out = np.zeros((len(column), 2 * p.permutations), np.uint16)
    sizes = np.zeros(len(column), np.int64)
    with np.errstate(over="ignore"):
        for i, j in tv.chunks(column):
            h, offsets = shingles(column.slice(i, j - i), p.shingle)
            sizes[i:j] = np.diff(offsets)
            full = np.flatnonzero(sizes[i:j])
            if not len(full):
                continue
            x = (h >> np.uint64(32)).astype(np.uint32)
            at = offsets[:-1][full]
            y = np.empty_like(x)
            for k in range(p.permutations):
                np.bitwise_xor(x, b[k], out=y)
                np.multiply(y, a[k], out=y)
                out[i + full, 2 * k] = np.minimum.reduceat(y, at).astype(np.uint16)
                out[i + full, 2 * k + 1] = np.maximum.reduceat(y, at).astype(np.uint16)
    return out, sizes


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(texts x bands) int64 keys; a key names its band."""
    n, m = sig.shape[0], sig.shape[1] // rows * rows
    sig = sig[:, :m]
    parts = sig.reshape(n, m // rows, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(m // rows, dtype=np.uint64)
    for k in range(rows):
        key = tv.mix(key * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, k])
    return key.view(np.int64)


def _signed(docs: DataFrame, p: MinHashParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, sizes = signatures(tv.strings(b.column("text")), p)
            full = np.flatnonzero(sizes)
            sig = sig[full]
            h = band_keys(sig, 2 * p.permutations)[:, 0] if len(full) else np.zeros(0, np.int64)
            g = band_keys(sig ^ np.uint16(0xA5A5), 2 * p.permutations)[:, 0] if len(full) else h
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(full)), pa.array(h), pa.array(g), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "h", "g", "sig"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return d.mapInArrow(lean(run), "doc_id long, h long, g long, sig binary")


def _verified(edges: DataFrame, sigs: DataFrame) -> DataFrame:
    """edges (doc, rep) with the share of equal signature values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("s", "t"))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("rep"), pa.array((s == t).mean(axis=1) if b.num_rows else np.zeros(0))], ["doc", "rep", "share"])

    both = edges.join(sigs.select(F.col("doc_id").alias("doc"), F.col("sig").alias("s")), "doc").join(sigs.select(F.col("doc_id").alias("rep"), F.col("sig").alias("t")), "rep")
    return both.select("doc", "rep", "s", "t").mapInArrow(lean(run), "doc long, rep long, share double")


def _joins(sig: np.ndarray, roots: np.ndarray, blocks: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows that are alike and that tie together what roots and the pairs before don't; with blocks, of rows of different ones."""
    group = np.unique(roots, return_inverse=True)[1]
    out = []
    for k in range(1, len(sig)):
        other = group[:k] != group[k]
        if blocks is not None:
            other &= blocks[:k] != blocks[k]
        rows = np.flatnonzero(other)
        if not len(rows):
            continue
        for r in rows[(sig[rows] == sig[k]).mean(axis=1) >= threshold].tolist():
            if group[r] != group[k]:
                out.append((k, r))
                group[group == group[r]] = group[k]
    return out


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """(doc_id, group_id) of every document that has near copies; group_id is the smallest doc_id of its group.

    Documents with equal signatures are collapsed first. In each bucket of a band every document is compared with the bucket's
    smallest id; in buckets whose documents that doesn't tie together, all pairs not yet tied are compared, block by block, so that
    neither a bucket's size nor its number of candidates is capped. Groups are the connected components of all pairs that share a
    band and pass the threshold (estimates as large as the threshold pass).

    Rows with a null doc_id or without words (null, empty, signs only) are in no group; texts of any length are hashed whole; rows that
    repeat a doc_id are one document, of which the row with the smallest signature hash counts; an empty table gives an empty
    result; other columns are not read.
    """
    return _groups(docs, p).select("doc_id", "group_id")


def _groups(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """near_duplicates, and whether rows of the doc_id differ in their texts."""
    spark = docs.sparkSession
    signed, signed_path = written(_signed(docs, p), "signatures")
    one = signed.groupBy("doc_id").agg(F.min(F.struct("h", "g")).alias("k"), F.max(F.struct("h", "g")).alias("l")).select("doc_id", "k.*", (F.col("k") != F.col("l")).alias("several"))
    # The smallest id of equal signatures is an aggregate, combined before the shuffle, that is joined back: no task holds all copies.
    reps = one.groupBy("h", "g").agg(F.min("doc_id").alias("rep"))
    exact, exact_path = written(one.join(reps, ["h", "g"]).select("doc_id", "rep", "h", "g", "several"), "exact")
    # Any row with the signature serves its representative.
    leaders = exact.where("doc_id = rep").select(F.col("rep"), F.col("h").alias("h2"), F.col("g").alias("g2"))
    sigs, sigs_path = written(signed.join(leaders, (signed.doc_id == leaders.rep) & (signed.h == leaders.h2) & (signed.g == leaders.g2)).dropDuplicates(["doc_id"]).select("doc_id", "sig"), "leaders")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = band_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(b.num_rows, -1), p.rows_per_band)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(b.column("doc_id").to_numpy(), k.shape[1]))], ["key", "doc"])

    keyed, keyed_path = written(sigs.mapInArrow(lean(keys), "key long, doc long"), "bands")
    leads = keyed.groupBy("key").agg(F.min("doc").alias("rep"), F.count("*").alias("m")).where("m > 1").select("key", "rep")
    bucket, bucket_path = written(keyed.join(leads, "key").where("doc != rep").select("key", "doc", "rep"), "bucket")
    checked, checked_path = written(_verified(bucket.select("doc", "rep").distinct(), sigs), "checked")
    led_edges = checked.where(F.col("share") >= p.threshold).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    tied, tied_path = written(components(led_edges), "tied")
    # Documents that the leaders already tie together need no further comparison; all others of a bucket do, with every other member.
    root = lambda c: tied.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    known = bucket.join(root("doc"), "doc", "left").join(root("rep"), "rep", "left").select("key", "doc", "rep", F.coalesce("doc_root", "doc").alias("doc_root"), F.coalesce("rep_root", "rep").alias("rep_root"))
    known, known_path = written(known, "known")
    mixed = known.groupBy("key").agg((F.count("*") + 1).alias("m"), F.max(F.col("doc_root") != F.col("rep_root")).alias("mixed")).where("mixed and m > 2").select("key", F.ceil(F.col("m") / p.block).cast("int").alias("blocks"))
    member = known.select("key", "doc", F.col("doc_root").alias("root")).union(known.select("key", F.col("rep").alias("doc"), F.col("rep_root").alias("root")).distinct())
    member = member.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "root").join(sigs.withColumnRenamed("doc_id", "doc"), "doc")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges that join the members of each (key, i, j), which follow each other; the last of a batch may go on in the next."""
        held = None
        for b in itertools.chain(batches, (None,)):
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            at = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cut = np.concatenate(([0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1))
            whole = t.num_rows if b is None else int(cut[-1])
            held = None if b is None else t.slice(whole)
            if not whole:
                continue
            t = t.slice(0, whole)
            docs, roots, blocks, i, j = (t.column(c).to_numpy() for c in ("doc", "root", "block", "i", "j"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(whole, -1)
            ends = np.append(cut[cut < whole], whole).tolist()
            x, y = [], []
            for f, g in zip(ends[:-1], ends[1:], strict=True):
                edges = _joins(sig[f:g], roots[f:g], blocks[f:g] if i[f] != j[f] else None, p.threshold)
                x += [docs[f + k] for k, _ in edges]
                y += [docs[f + k] for _, k in edges]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    more = member.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "block", "doc", "root", "sig").mapInArrow(lean(compared), "a long, b long")
    alike = tied.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more.distinct())
    roots, roots_path = written(components(alike), "roots")
    groups = exact.join(roots, exact.rep == roots.id, "left").select("doc_id", F.coalesce("root", "rep").alias("group_id"), "several")
    dropped(spark, signed_path, sigs_path, keyed_path, bucket_path, checked_path, tied_path, known_path)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return groups.join(sizes, "group_id", "left_semi").select("doc_id", "group_id", "several")


def deduplicated(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """docs without the near copies: of each group the document with the smallest doc_id stays, with all its columns; ungrouped rows all stay.

    Rows with a null doc_id and texts without words stay. An id that different texts share stays with all of them, since the id can't
    say which of them goes; equal rows of an id stay or go together. An empty table gives an empty one.
    """
    gone, _ = written(_groups(docs, p).where("doc_id != group_id and not several").select("doc_id"), "copies")
    return without(docs, gone)
