"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are lower-case words and runs of signs; features are hashed unigrams and bigrams (a bigram of a token with itself is one
shared feature, so that stuttering is learned whatever the word) with the value log2(1 + count). Two heads share the features:
one for quality, one for toxicity. A text is scored as a sparse dot product with the broadcast weights, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import lean

HEADS = ("quality", "toxic")


@dataclass(frozen=True)
class QualityParams:
    bits: int = 18
    #: By head: toxicity shows in few words, so its weights learn faster and are kept sparser.
    alpha: tuple[float, float] = (0.1, 0.5)
    beta: float = 1.0
    #: At max_train_rows rows; in proportion below.
    l1: tuple[float, float] = (1.0, 20.0)
    l2: float = 0.1
    epochs: int = 2
    #: The labelled rows to train on: those with the smallest hash of doc_id, at most so many.
    max_train_rows: int = 16384
    #: Every so-manieth training row is held out to set the thresholds.
    holdout: int = 4
    #: The share of held-out good documents that a threshold may reject.
    false_rejects: float = 0.003


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # heads x 2**bits, float32
    bias: np.ndarray
    thresholds: np.ndarray  # keep if quality >= thresholds[0] and toxicity < thresholds[1]
    rows: int


_SAME = np.uint64(0x5AE5AE5AE5AE5AE5)


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets by text, feature indices (ascending and distinct within a text) and values."""
    t = tv.tokenize(column, tv.SIGN_CLASS)
    text = t.text_of
    two, at = tv.ngrams(t, 2)
    two[t.hashes[at] == t.hashes[at + 1]] = _SAME if len(at) else 0
    shift = np.uint64(64 - bits)
    keys = np.concatenate(((text.astype(np.uint64) << np.uint64(bits)) | (t.hashes >> shift), (text[at].astype(np.uint64) << np.uint64(bits)) | (two >> shift)))
    keys.sort()
    first = tv.starts_of(keys)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    offsets = np.searchsorted(keys, np.arange(len(column) + 1, dtype=np.uint64) << np.uint64(bits))
    return offsets, (keys & np.uint64((1 << bits) - 1)).astype(np.int64), np.log2(1 + counts).astype(np.float32)


def margins(column: pa.Array, weights: np.ndarray, bias: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits (texts x heads) of a large_string array, and how many features each text has."""
    out = np.zeros((len(column), len(weights)))
    sizes = np.zeros(len(column), np.int64)
    for a, b in tv.chunks(column):
        offsets, index, value = features(column.slice(a, b - a), bits)
        sizes[a:b] = np.diff(offsets)
        full = np.flatnonzero(sizes[a:b])
        if len(full):
            for h in range(len(weights)):
                out[a + full, h] = np.add.reduceat(weights[h][index] * value, offsets[:-1][full], dtype=np.float64)
    return out + bias, sizes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: pa.Array, labels: np.ndarray, p: QualityParams) -> QualityModel:
    """FTRL-proximal over the texts in their order; labels: texts x heads, NaN where there is none."""
    heads, dim = len(HEADS), 1 << p.bits
    z, n = np.zeros((heads, dim + 1)), np.zeros((heads, dim + 1))
    l1, alpha = np.array(p.l1)[:, None] * min(1, len(texts) / p.max_train_rows), np.array(p.alpha)[:, None]
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in tv.chunks(texts):
        offsets, index, value = features(texts.slice(a, b - a), p.bits)
        rows += [(np.append(index[i:j], dim).astype(np.int32), np.append(value[i:j], np.float32(1))) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
    known = ~np.isnan(labels)
    y = np.nan_to_num(labels)
    hold = np.arange(len(rows)) % p.holdout == p.holdout - 1

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((p.beta + np.sqrt(ni)) / alpha + p.l2))

    for _ in range(p.epochs):
        for i, (index, value) in enumerate(rows):
            if hold[i]:
                continue
            zi, ni = z[:, index], n[:, index]
            w = weights(zi, ni)
            g = ((sigmoid(w @ value) - y[i]) * known[i])[:, None] * value
            nn = ni + g * g
            z[:, index] = zi + g - (np.sqrt(nn) - np.sqrt(ni)) / alpha * w
            n[:, index] = nn
    w = weights(z, n).astype(np.float32)
    thresholds = np.array([0.0, 2.0])  # nothing is rejected where the held-out rows show no difference
    at = np.flatnonzero(hold)
    scores = np.array([sigmoid(w[:, rows[i][0]] @ rows[i][1]) for i in at]).reshape(-1, heads)
    for h, good in ((0, 1), (1, 0)):
        s = scores[:, h] if h == 0 else -scores[:, h]
        side = known[at, h]
        fine, bad = s[side & (y[at, h] == good)], s[side & (y[at, h] != good)]
        cuts = np.unique(np.concatenate((fine, bad)))
        if len(fine) and len(bad) and len(cuts) > 1:
            # The cut of the best balanced accuracy, lowered until it rejects no more good documents than allowed.
            mids = (cuts[1:] + cuts[:-1]) / 2
            fine.sort(), bad.sort()
            gain = np.searchsorted(bad, mids) / len(bad) - np.searchsorted(fine, mids) / len(fine)
            gain[np.searchsorted(fine, mids) > p.false_rejects * len(fine)] = -1
            best = np.flatnonzero(gain == gain.max())
            if gain.max() > 0:
                thresholds[h] = abs(mids[best[len(best) // 2]])
    return QualityModel(w[:, :dim].copy(), w[:, dim].astype(float), thresholds, len(rows))


def train(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> QualityModel:
    """Fit on at most ``max_train_rows`` labelled documents, in one task of bounded size.

    Rows with a null id, text or both labels don't count. Of the documents that share an id the smallest text counts, once; of labels
    that do, the smaller quality and the larger toxicity. Every ``holdout``-th row only sets the thresholds; where these rows don't
    hold both kinds of a label, its head rejects nothing. The first penalty is in proportion to the number of rows. Empty and
    very long texts are rows like others. Without rows every weight is 0.
    """
    spark = docs.sparkSession
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    lab = lab.where("_id is not null and (quality is not null or toxic is not null)").groupBy("_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(p.max_train_rows)  # a bounded table: a few bytes for each of at most max_train_rows rows
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = d.join(F.broadcast(lab), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "text")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for b in batches:
            texts.append(tv.strings(b.column("text")))
            ys.append(np.column_stack([b.column(h).to_numpy(zero_copy_only=False).astype(float) for h in HEADS]))
        if not texts:
            return
        m = fit(pa.concat_arrays(texts), np.concatenate(ys), p)
        yield pa.RecordBatch.from_pydict({"weights": [m.weights.tobytes()], "bias": [m.bias.tolist()], "thresholds": [m.thresholds.tolist()], "n": [m.rows]})

    got = rows.select("text", *HEADS).mapInArrow(lean(one), "weights binary, bias array<double>, thresholds array<double>, n long").collect()
    if not got:
        return QualityModel(np.zeros((2, 1 << p.bits), np.float32), np.zeros(2), np.array([0.5, 0.5]), 0)
    r = got[0]
    return QualityModel(np.frombuffer(r["weights"], np.float32).reshape(2, -1).copy(), np.array(r["bias"]), np.array(r["thresholds"]), r["n"])


def score(docs: DataFrame, model: QualityModel, p: QualityParams = QualityParams(), carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Every row's (carried columns,) quality, toxicity and keep; one narrow pass, no shuffle.

    A null, empty or blank text has quality 0, toxicity 0 and isn't kept; a text of any length is scored whole. Rows repeat as they do in docs; only doc_id and text
    (or the carried columns) are read, so other columns may have any name. With no training rows every text scores 0.5 and stays.
    """
    carry = ["doc_id"] if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.thresholds))
    untrained = model.rows == 0
    out = docs.select(*carry, *([] if text_col in carry else [text_col]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) + ", quality double, toxicity double, keep boolean"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, thresholds = shared.value
        for b in batches:
            logits, sizes = margins(tv.strings(b.column(text_col)), weights, bias, p.bits)
            s = sigmoid(logits)
            s[sizes == 0] = 0
            keep = (sizes > 0) & (untrained | ((s[:, 0] >= thresholds[0]) & (s[:, 1] < thresholds[1])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(keep)], [*carry, "quality", "toxicity", "keep"])

    return out.mapInArrow(lean(scored), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, quality, toxicity and keep of every row of docs, from a model trained on the labels; odd rows are treated as ``train`` and ``score`` say."""
    return score(docs, train(docs, labels, p), p)


def quality_filter(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps.

    Null, empty and blank texts go; null ids don't matter; repeated rows all stay or all go; without usable labels every row with a word
    stays; an empty table gives an empty one; columns of any name stay. docs without a column text is an error.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n.lower(): i for i, n in enumerate(names)}
    if "text" not in at:
        raise ValueError("docs has no column text")
    kept = score(plain, train(docs, labels, p), p, carry=plain.columns, text_col=f"c{at['text']}").where("keep")
    return kept.select(*plain.columns).toDF(*names)
