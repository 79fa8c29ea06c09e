from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from glossa.llm import impact
from glossa.llm.common import table as read
from tests.llm.helpers import SCHEMA, odd_rows, prose, row, rows_of, table
from tests.oracle import differences

QUERY = "item_id long, text string"


def words(text):
    return re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())


def brute(queries, docs, p=impact.SearchParams()):
    docs = [(i, words(t)) for i, t in docs if i is not None]
    n = len(docs)
    mean = sum(len(w) for _, w in docs) / max(n, 1) or 1.0
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for q, text in queries:
        qf = Counter(words(text))
        scored = []
        for i, w in docs:
            tf = Counter(w)
            s = sum(f * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (p.k1 + 1) / (tf[t] + p.k1 * (1 - p.b + p.b * len(w) / mean)) for t, f in qf.items() if t in tf)
            if any(t in tf for t in qf):
                scored.append((-round(s, 9), i))
        out += [(q, k + 1, i, round(-s, 6)) for k, (s, i) in enumerate(sorted(scored)[: p.k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("p", [impact.SearchParams(), impact.SearchParams(k=3, levels=7, shard_docs=16), impact.SearchParams(k=1, shard_docs=5, pass_terms=3)])
def test_against_brute_force(spark, p):
    r = random.Random(4)
    vocab = prose(1, 60).split()
    docs = [(i, " ".join(r.choices(vocab, weights=[1 / (k + 1) for k in range(60)], k=r.randint(0, 60)))) for i in range(120)]
    docs += [(200 + i, docs[0][1]) for i in range(15)]  # ties
    queries = [(i, " ".join(r.choices(vocab, k=r.randint(1, 12)))) for i in range(20)]
    got = impact.top_k(spark.createDataFrame(queries, QUERY), table(spark, [row(i, t) for i, t in docs]).repartition(3), p)
    want, have = brute(queries, docs, p), rows_of(got)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(have, want, strict=True))


def test_stops_on_proof():
    """With one rare and many common terms, not all segments are processed, and the result is that of processing all."""
    import numpy as np

    n = 4000
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 60, n)
    p = impact.SearchParams(k=5)
    postings = {}
    for t in range(12):
        docs = np.sort(rng.choice(n, 20 if t == 0 else 1500, replace=False))
        tf = rng.integers(1, 6, len(docs)).astype(float)
        part = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[docs] / 40))
        level = np.clip(np.ceil(part / 2.2 * 63 - 1e-9), 1, 63).astype(np.uint8)
        order = np.lexsort((docs, -level.astype(int)))
        postings[t] = docs[order].astype(np.uint16), tf[order], level[order]
    idf = np.array([9.0] + [0.2] * 11)
    found, score = impact.search_shard([(np.arange(12), np.ones(12, int))], postings, sizes, np.arange(n), idf, 40.0, p)[0]
    full = np.zeros(n)
    for t, (docs, tf, _) in postings.items():
        full[docs] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[docs] / 40))
    best = np.lexsort((np.arange(n), -np.round(full, 9)))[:5]
    assert found.tolist() == best.tolist() and np.allclose(score, full[best])


def test_against_sql(spark, data, duck):
    df = impact.top_k(read(spark, data, "benchmark"), read(spark, data, "documents"))
    assert differences(df, impact.ORACLE, duck) == ""


def test_odd_rows(spark):
    docs = table(spark, odd_rows(), clash=True)
    queries = [(1, None), (2, ""), (3, "nothingmatchesthis"), (4, prose(3, 40)), (4, prose(3, 40)), (None, "one"), (5, "ÜNÏCODE 漢字"), (6, prose(2, 60_000))]
    got = impact.top_k(spark.createDataFrame(queries, QUERY).selectExpr("*", "'x' as doc_id", "1 as rank", "2 as q"), docs)
    pairs = [(r.item_id, r.rank, r.doc_id) for r in got.collect()]
    want = brute(queries, [(r[0], r[1]) for r in odd_rows()])
    assert sorted(pairs, key=repr) == sorted([x[:3] for x in want], key=repr)
    assert (None, 1, 9) in pairs and (5, 1, 8) in pairs
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(impact.top_k(spark.createDataFrame([], QUERY), docs)) == [] and rows_of(impact.top_k(spark.createDataFrame(queries, QUERY), none)) == []
