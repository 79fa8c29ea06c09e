from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import quality as q
from glossa.llm import textvec as tv
from glossa.llm.common import table as read
from tests.llm.helpers import SCHEMA, odd_rows, prose, row, rows_of, table

LABELS = "doc_id long, quality int, toxic int"


def plain_features(text: str, bits: int) -> dict[int, float]:
    """Features from a regular expression and single hashes."""
    toks = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+|[!-/:-@\[-^`{-~]+", text.lower())
    h = [tv.hash_word(t) for t in toks]
    idx = Counter(x >> (64 - bits) for x in h)
    for a, b in zip(h, h[1:]):
        two = np.zeros(1, np.uint64)
        for x in (a, b):
            two = tv.mix(two * np.uint64(0x2545F4914F6CDD1D) + np.uint64(x))
        idx[int(q._SAME if a == b else two[0]) >> (64 - bits)] += 1
    return {k: math.log2(1 + n) for k, n in idx.items()}


def test_margins_equal_brute_force():
    texts = ["the cat sat on the mat", "", "no no no!!! stop -- stop", None, "é漢字 déjà vu", prose(4, 3000)]
    rng = np.random.default_rng(0)
    w = rng.normal(size=(2, 1 << 12)).astype(np.float32)
    got, sizes = q.margins(tv.strings(pa.array(texts)), w, np.array([0.5, -1.0]), 12)
    for i, t in enumerate(texts):
        f = plain_features(t or "", 12)
        assert sizes[i] == len(f)
        want = [sum(float(w[h][k]) * v for k, v in f.items()) + b for h, b in ((0, 0.5), (1, -1.0))]
        assert np.allclose(got[i], want, atol=1e-3)


def test_ftrl_follows_the_update_rule():
    """One pass over two texts of one head, against the rule written out for each weight."""
    texts = ["good fine good", "bad poor"]
    p = q.QualityParams(bits=10, epochs=1, l1=(0.0, 0.0))
    y = np.array([[1, np.nan], [0, np.nan]])
    m = q.fit(pa.array(texts, pa.large_string()), y, p)
    z, n = Counter(), Counter()

    def weight(k):
        return -z[k] / ((p.beta + math.sqrt(n[k])) / p.alpha[0] + p.l2)

    for t, label in zip(texts, (1, 0)):
        f = plain_features(t, 10) | {"bias": 1.0}
        w = {k: weight(k) for k in f}
        s = 1 / (1 + math.exp(-sum(w[k] * v for k, v in f.items())))
        for k, v in f.items():
            g = (s - label) * v
            sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / p.alpha[0]
            z[k] += g - sigma * w[k]
            n[k] += g * g
    for k in z:
        got = m.bias[0] if k == "bias" else m.weights[0][k]
        assert got == pytest.approx(weight(k), abs=1e-5)
    assert np.abs(m.weights[1]).max() == 0  # the head without labels


def test_held_out_accuracy(spark, data):
    """Trained without them, the labelled documents of one half are told apart."""
    docs, labels = read(spark, data, "documents").toPandas(), read(spark, data, "labels").toPandas()
    both = labels.merge(docs, on="doc_id")
    a, b = both[both.index % 2 == 0], both[both.index % 2 == 1]
    m = q.fit(pa.array(a.text, pa.large_string()), a[["quality", "toxic"]].to_numpy(float), q.QualityParams())
    logits, _ = q.margins(pa.array(b.text, pa.large_string()), m.weights, m.bias, 18)
    good, bad = logits[b.quality.to_numpy() == 1, 0], logits[b.quality.to_numpy() == 0, 0]
    auc = (good[:, None] > bad[None, :]).mean()
    assert auc > 0.9


def test_held_out_toxicity():
    """With 2,000 labels, most toxic documents of the other half go and nearly all good ones stay."""
    import os

    import pandas as pd

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip(f"{folder} is missing")
    both = pd.read_parquet(f"{folder}/labels.parquet").merge(pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]), on="doc_id").sample(frac=1, random_state=1)
    a, b = both[: len(both) // 2], both[len(both) // 2 :]
    m = q.fit(pa.array(a.text, pa.large_string()), a[["quality", "toxic"]].to_numpy(float), q.QualityParams())
    s = q.sigmoid(q.margins(pa.array(b.text, pa.large_string()), m.weights, m.bias, 18)[0])
    keep = (s[:, 0] >= m.thresholds[0]) & (s[:, 1] < m.thresholds[1])
    quality, toxic = b.quality.to_numpy(), b.toxic.to_numpy()
    assert keep[(quality == 1) & (toxic == 0)].mean() >= 0.99
    assert keep[toxic == 1].mean() <= 0.4 and keep[quality == 0].mean() <= 0.1


def test_labelled_documents_are_kept_or_rejected(spark, data):
    scored = q.quality_scores(read(spark, data, "documents"), read(spark, data, "labels")).toPandas()
    both = scored.merge(read(spark, data, "labels").toPandas().rename(columns={"quality": "label"}), on="doc_id")
    fine = both[(both.label == 1) & (both.toxic == 0)]
    assert fine.keep.mean() >= 0.95  # of 67
    assert len(scored) == read(spark, data, "documents").count()


def test_odd_rows(spark):
    docs = table(spark, odd_rows() + [row(20 + i, prose(50 + i, 30)) for i in range(4)], clash=True)
    labels = spark.createDataFrame([(20, 1, 0), (20, 1, 0), (21, 0, 1), (22, None, None), (None, 1, 0), (23, 1, None), (1, 1, 0), (99, 1, 1)], LABELS)
    got = q.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.quality is not None and 0 <= r.toxicity <= 1
    assert all(not r.keep and r.quality == 0 for r in got if r.doc_id in (1, 2, 3))
    kept = q.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.keep for r in got)


def test_empty_tables_and_no_labels(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(q.quality_scores(none, spark.createDataFrame([], LABELS))) == []
    got = q.quality_scores(table(spark, [row(1, "some words"), row(2, None)]), spark.createDataFrame([], LABELS)).collect()
    assert [(r.doc_id, r.quality, r.keep) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, 0.5, True), (2, 0.0, False)]


def test_the_bound_counts_ids_not_rows(spark):
    """Rows that repeat an id don't swell the training set, and no row count changes how thresholds are set."""
    docs = table(spark, [row(i, prose(i, 20)) for i in range(30)] + [row(3, prose(900 + k, 20)) for k in range(50)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], LABELS)
    assert q.train(docs, labels).rows == 30
    assert q.train(docs, labels, q.QualityParams(max_train_rows=8)).rows == 8
    with pytest.raises(ValueError):
        q.quality_filter(docs.drop("text"), labels)
