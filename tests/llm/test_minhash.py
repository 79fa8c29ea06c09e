from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import minhash as m
from glossa.llm import textvec as tv
from glossa.llm.common import table as read
from glossa.llm.graph import components
from tests.llm.helpers import SCHEMA, odd_rows, prose, row, rows_of, table


def shingle_set(text: str, n: int = 3) -> frozenset:
    w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(text: str, every: int) -> str:
    w = text.split()
    return " ".join("changed" if i % every == every - 1 else x for i, x in enumerate(w))


def test_signature_is_minimum_and_maximum_of_each_permutation():
    p = m.MinHashParams(permutations=8)
    texts = pa.array(["one two three four five six", "a b", "", "x y z x y z x y z"], pa.large_string())
    sig, sizes = m.signatures(texts, p)
    rng = np.random.default_rng(p.seed)
    a = (rng.integers(0, 2**32, 8, np.uint64) | 1).astype(np.uint32)
    b = rng.integers(0, 2**32, 8, np.uint64).astype(np.uint32)
    for i, t in enumerate(texts.to_pylist()):
        h, _ = m.shingles(pa.array([t], pa.large_string()), 3)
        assert sizes[i] == len(h)
        if not len(h):
            continue
        for k in range(8):
            y = [((int(x) >> 32) ^ int(b[k])) * int(a[k]) % 2**32 for x in h]
            assert (sig[i, 2 * k], sig[i, 2 * k + 1]) == (min(y) & 0xFFFF, max(y) & 0xFFFF)


def test_a_pair_at_the_threshold_becomes_a_candidate():
    """Of pairs with 0.6 of their signature values equal at least 0.9 share a band, as asked for at the operator's own threshold."""
    p, r = m.MinHashParams(), np.random.default_rng(5)
    a = r.integers(0, 2**16, (2000, 2 * p.permutations)).astype(np.uint16)
    b = np.where(r.random(a.shape) < p.threshold, a, a ^ np.uint16(1))
    assert (m.band_keys(a, p.rows_per_band) == m.band_keys(b, p.rows_per_band)).any(axis=1).mean() >= 0.95


def test_estimate_is_unbiased():
    base = prose(7, 400)
    other = edited(base, 12)
    true = jaccard(shingle_set(base), shingle_set(other))
    shares = []
    for seed in range(30):
        sig, _ = m.signatures(pa.array([base, other], pa.large_string()), m.MinHashParams(seed=seed))
        shares.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(shares) - true) < 0.02


def test_groups_against_all_pairs(spark, data):
    """Recall of pairs whose exact similarity is clearly above the threshold; no group without a similar pair."""
    docs = read(spark, data, "documents")
    rows = docs.select("doc_id", "text").toPandas()
    sets = [shingle_set(t) for t in rows.text]
    group = dict(m.near_duplicates(docs).collect())
    ids = rows.doc_id.tolist()
    found = total = 0
    for i in range(len(ids)):
        like = []
        for j in range(len(ids)):
            if i != j and sets[i] and sets[j]:
                s = jaccard(sets[i], sets[j])
                like.append(s)
                if i < j and s >= 0.75:
                    total += 1
                    found += group.get(ids[i], -1) == group.get(ids[j], -2)
        if ids[i] in group:
            assert max(like) >= 0.45, ids[i]
    assert total > 10 and found / total >= 0.95


def test_planted_copies(spark):
    rows = []
    for g in range(20):
        base = prose(100 + g, 120)
        rows += [row(1000 * g, base), row(1000 * g + 1, base), row(1000 * g + 2, edited(base, 40)), row(1000 * g + 3, prose(900 + g, 120))]
    got = dict(m.near_duplicates(table(spark, rows)).collect())
    assert got == {1000 * g + k: 1000 * g for g in range(20) for k in range(3)}
    left = {r.doc_id for r in m.deduplicated(table(spark, rows)).collect()}
    assert left == {1000 * g + k for g in range(20) for k in (0, 3)}


def test_large_group_and_shared_beginning(spark):
    """Hundreds of copies are one group; documents that only share a passage are none."""
    base, shared = prose(1, 80), prose(2, 12)
    rows = [row(i, base) for i in range(300)] + [row(1000 + i, shared + " " + prose(500 + i, 100)) for i in range(60)]
    got = dict(m.near_duplicates(table(spark, rows)).collect())
    assert got == {i: 0 for i in range(300)}


def star(seed: int, copies: int) -> list[str]:
    """Copies that keep another 85 % of an original's passages each: near the original, seldom near one another; the original is last."""
    r = random.Random(seed)
    passages = [prose(100_000 * seed + i, 30) for i in range(60)]
    fresh = iter(range(10**9))
    mark = "\n".join
    return [mark(x if r.random() < 0.85 else prose(10**8 * seed + next(fresh), 30) for x in passages) for _ in range(copies)] + [mark(passages)]


@pytest.mark.parametrize("block", [1024, 7])
def test_every_pair_of_a_band_is_compared(spark, block):
    """Groups are the components of all pairs that share a band and pass the threshold, though only the last document ties them together."""
    texts = [t for seed in (1, 2) for t in star(seed, 60)]
    p = m.MinHashParams(**({"block": block} if hasattr(m.MinHashParams(), "block") else {}))
    sig, _ = m.signatures(pa.array(texts, pa.large_string()), p)
    bands = m.band_keys(sig, p.rows_per_band)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (bands[i] == bands[j]).any() and (sig[i] == sig[j]).mean() >= p.threshold and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    want = {i: x for i, x in enumerate(root) if root.count(x) > 1}
    assert len(want) > 110
    assert dict(m.near_duplicates(table(spark, [row(i, t) for i, t in enumerate(texts)]), p).collect()) == want


def test_odd_rows(spark):
    docs = table(spark, odd_rows() + [row(30, "!!! ???"), row(31, prose(2, 60_000)), row(32, "ONE."), row(33, "")], clash=True)
    assert rows_of(m.near_duplicates(docs)) == [(31, 5), (32, 9), (5, 5), (6, 6), (7, 6), (9, 9)]
    left = m.deduplicated(docs)
    assert left.columns == docs.columns
    gone = {31, 32, 7}
    assert sorted(map(str, [r.doc_id for r in left.collect()])) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in gone)
    assert rows_of(m.near_duplicates(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(m.deduplicated(spark.createDataFrame([], SCHEMA))) == []


def test_an_id_of_different_texts_loses_none(spark):
    base, other = prose(1, 80), prose(2, 80)
    docs = table(spark, [row(1, base), row(5, base), row(5, other), row(6, other), row(7, base)])
    left = sorted((r.doc_id, r.text == base) for r in m.deduplicated(docs).collect())
    assert [x for x in left if x[0] == 5] == [(5, False), (5, True)] and (7, True) not in left and (1, True) in left


def test_components_of_hubs(spark):
    edges = [(0, i) for i in range(1, 400)] + [(500, i) for i in range(399, 450)]
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == {i: 0 for i in [*range(450), 500]}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_hash_word_is_the_tokenizers():
    t = tv.tokenize(pa.array(["Héllo wörld 42"], pa.large_string()))
    assert t.hashes.tolist() == [tv.hash_word(w) for w in ("héllo", "wörld", "42")]
