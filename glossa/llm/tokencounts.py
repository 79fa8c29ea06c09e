"""Token counts through a digest cache.

The cache is a Parquet folder of (digest, tokens) for each tokenizer version. Documents are reduced to the digest of their normalised
content; digests that the cache lacks are encoded once each, whatever the number of copies, and appended.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


@dataclass(frozen=True)
class TokenCountParams:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    #: Changes of normalised() need another number, so that older counts aren't used.
    normalisation: int = 1
    #: Up to so many misses (a digest and an id each) are broadcast, and no text is shuffled; beyond, all texts are.
    broadcast_misses: int = 1_000_000


def normalised(text: str) -> str:
    """NFC with line feeds as line ends."""
    return unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")


def content_digest(text: str) -> bytes:
    return hashlib.blake2b(normalised(text).encode("utf-8", "replace"), digest_size=16).digest()


def version(p: TokenCountParams) -> str:
    """Digest of all that counts depend on: vocabulary, pattern, library and normalisation."""
    h = hashlib.sha256(Path(p.vocabulary).read_bytes())
    h.update(f"\0{p.pattern}\0{tiktoken.__version__}\0{p.normalisation}".encode())
    return h.hexdigest()[:32]


def encoder(vocabulary: bytes, p: TokenCountParams) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("counted", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})


def count(enc: tiktoken.Encoding, text: str) -> int:
    return len(enc.encode_ordinary(text))


def _cached(docs: DataFrame, path: str) -> DataFrame | None:
    spark = docs.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    # Runs at the same time may have appended the same digest twice.
    return spark.read.schema("digest binary, tokens long").parquet(path).groupBy("digest").agg(F.max("tokens").alias("tokens"))


def token_counts(docs: DataFrame, cache: str, p: TokenCountParams = TokenCountParams()) -> DataFrame:
    """(doc_id, tokens) of every row of docs; the cache folder has all their digests afterwards.

    A null or empty text has 0 tokens and isn't cached. Repeated rows repeat in the result. A null doc_id is kept. Only doc_id and
    text are read, so other columns may have any name. Texts of any length are encoded whole. Texts that are equal once normalised have
    one cache entry, whichever of them is encoded. An empty table gives an empty result and leaves the cache as it is.
    """
    spark = docs.sparkSession
    path = f"{cache}/{version(p)}"
    vocabulary = spark.sparkContext.broadcast(Path(p.vocabulary).read_bytes())
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([content_digest(t) if t else None for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "digest"])

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([content_digest(t) for t in texts], pa.binary()), b.column("text")], ["doc_id", "digest", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = None, set()
        for b in batches:
            enc = enc or encoder(vocabulary.value, p)
            keys, counts = [], []
            for key, text in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    counts.append(count(enc, normalised(text)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["digest", "tokens"])

    hashed, hashed_path = written(d.mapInArrow(digests, f"doc_id {kind}, digest binary"), "digests")
    # One row for each miss, named by its digest and the smallest doc_id that has it: the text of other copies is never encoded.
    missing = hashed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("owner"))
    known = _cached(docs, path)
    if known is not None:
        missing = missing.join(known, "digest", "left_anti")
    lean, lean_path = written(missing.withColumnRenamed("digest", "key"), "missing")
    if (misses := lean.count()) > 0:
        few = misses <= p.broadcast_misses
        near = F.broadcast if few else lambda x: x.hint("shuffle_hash")
        texts = d.where("text != ''")
        if few:  # rows that own no miss are dropped before their text is digested again
            owners = lean.select("owner").distinct()
            texts = texts.join(F.broadcast(owners), texts.doc_id.eqNullSafe(owners.owner), "left_semi")
        texts = texts.mapInArrow(with_text, f"doc_id {kind}, digest binary, text string")
        chosen = texts.join(near(lean), (texts.digest == lean.key) & texts.doc_id.eqNullSafe(lean.owner), "left_semi")
        chosen.select("digest", "text").mapInArrow(encode, "digest binary, tokens long").write.mode("append").parquet(path)
    dropped(spark, lean_path)
    known = _cached(docs, path)
    if known is None:
        return hashed.select("doc_id", F.lit(0).cast("long").alias("tokens"))
    return hashed.join(known, "digest", "left").select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
