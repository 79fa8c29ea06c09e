from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from glossa.llm import decontaminate as d
from glossa.llm import textvec as tv
from glossa.llm.common import table as read
from tests.llm.helpers import SCHEMA, odd_rows, prose, row, rows_of, table

ITEMS = "item_id long, text string"


def words(text: str | None) -> list[str]:
    return re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())


def plain_lcs(a: list, b: list) -> int:
    row_ = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row_[j] + 1 if x == y else max(row_[j + 1], new[-1]))
        row_ = new
    return row_[-1]


def brute_overlap(item: list[str], text: list[str]) -> float:
    """The largest share over all stretches, wherever they begin."""
    span = d.window(len(item))[0]
    return max((plain_lcs(item, text[a : a + span]) / len(item) for a in range(0, max(1, len(text) - span + 1))), default=0.0)


def test_bit_parallel_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(1, 90))] for _ in range(2))
        masks = d.bit_masks(a)
        assert d.lcs([masks.get(x, 0) for x in b], len(a)) == plain_lcs(a, b)


def test_passing_over_stretches_changes_nothing():
    r = random.Random(2)
    for _ in range(200):
        a = [r.randint(0, 25) for _ in range(r.randint(1, 40))]
        b = [r.choice(a) if r.random() < 0.5 else r.randint(0, 60) for _ in range(r.randint(0, 160))]
        span, stride = d.window(len(a))
        full = max((plain_lcs(a, b[s : s + span]) for s in range(0, max(1, len(b) - span + stride), stride)), default=0) / len(a)
        assert d.best_overlap(len(a), d.bit_masks(a), b) == full
        assert d.best_overlap(len(a), d.bit_masks(a), b, 0.55) == (full if full >= 0.55 - 1e-12 else 0.0)


def index_of(texts: list[str], corpus: list[str] = (), p: d.LsiParams = d.LsiParams()) -> d.Index:
    weights = d.Weights(np.ones(1 << p.bits), 1000, p)
    return d.Index(d.items_of([(k, x, None) for k, x in enumerate(texts)]), weights, np.zeros((1 << p.bits, 1), np.float32), p)


def test_possible_keeps_all_that_overlap():
    r = random.Random(3)
    names = [f"w{i}" for i in range(41)]
    items = [[r.randint(0, 40) for _ in range(n)] for n in (5, 20, 37, 60)]
    index = index_of([" ".join(names[i] for i in x) for x in items])
    text = [r.randint(0, 50) for _ in range(3000)]
    for k, x in enumerate(items):  # planted copies
        text[200 + 300 * k : 200 + 300 * k + len(x)] = x
    hashes = tv.tokenize(pa.array([" ".join(names[i] if i < 41 else "foreign" for i in text)], pa.large_string())).hashes
    slots = np.full(3000, -1)
    at, slot = index.vocab.find(hashes)
    slots[at] = slot
    lo = np.array([r.randint(0, 2900) for _ in range(500)] + [150, 450, 750, 1050])
    hi = np.minimum(lo + 150, 3000)
    item = np.array([r.randrange(4) for _ in range(500)] + [0, 1, 2, 3])
    keep = index.possible(slots, lo, hi, item, np.full(len(item), 0.55))
    assert keep[-4:].all() and not keep.all()
    for a, b, k, ok in zip(lo, hi, item, keep, strict=True):
        if d.best_overlap(len(items[k]), index.items[k].masks, hashes[a:b].tolist(), 0.55) > 0:
            assert ok


def test_passages_are_pairs_of_blocks():
    start, two = d.joined(np.array([0, 3, 3, 4, 6]))
    assert start.tolist() == [0, 1, 3, 4] and two.tolist() == [True, True, False, True]


def test_sums_of_rows():
    rng = np.random.default_rng(0)
    table_ = rng.normal(size=(50, 7))
    group = np.sort(np.concatenate((rng.integers(0, 40, 300), np.full(200, 41))))
    index = rng.integers(0, 50, 500)
    got, names = d.sum_rows(table_, index, group)
    assert names.tolist() == sorted(set(group.tolist()))
    for g, x in zip(names, got, strict=True):
        assert np.allclose(x, table_[index[group == g]].sum(0))
    assert d.sum_rows(table_, index[:0], group[:0])[0].shape == (0, 7)


def test_against_brute_force(spark, data):
    """Every document that clearly contains an item is found, and nothing is reported that doesn't overlap."""
    docs, items = read(spark, data, "documents"), read(spark, data, "benchmark")
    got = {(r.doc_id, r.item_id): r.overlap for r in d.contaminated(docs, items).collect()}
    bench = [(r.item_id, words(r.text)) for r in items.collect()]
    total = found = 0
    for r in docs.collect():
        t = words(r.text)
        here = set(t)
        for key, w in bench:
            if len(here & set(w)) < 0.55 * len(set(w)) and (r.doc_id, key) not in got:
                continue
            share = brute_overlap(w, t)
            if (r.doc_id, key) in got:
                assert share >= got[r.doc_id, key] - 1e-6 >= 0.54
            if share >= 0.8:
                total += 1
                found += (r.doc_id, key) in got
    assert total > 0 and found / total >= 0.9


def test_paraphrases_and_clean_documents(spark):
    r = random.Random(5)
    items = [(k, prose(2000 + k, 35)) for k in range(30)]
    rows = []
    for k, text in items:
        w = text.split()
        changed = [x if r.random() > 0.15 else "swapped" for x in w]
        rows += [row(k, prose(3000 + k, 100) + " " + text + " " + prose(4000 + k, 60)), row(100 + k, prose(5000 + k, 333) + " " + " ".join(changed)), row(200 + k, prose(6000 + k, 200)), row(300 + k, " ".join(r.sample(w, 8)) + " " + prose(7000 + k, 50))]
    got = {(x.doc_id, x.item_id) for x in d.contaminated(table(spark, rows), spark.createDataFrame(items, ITEMS)).collect()}
    assert {(k, k) for k, _ in items} <= got
    assert len({(100 + k, k) for k, _ in items} & got) >= 27
    assert not {p for p in got if p[0] >= 200}


def test_results_of_an_item_do_not_depend_on_the_others(spark):
    items = [(k, prose(8000 + k, 20)) for k in range(50)]
    rows = [row(k, prose(9000 + k, 30) + " " + t) for k, t in items] + [row(100, prose(1, 50))]
    docs = table(spark, rows)
    whole = rows_of(d.contaminated(docs, spark.createDataFrame(items, ITEMS)))
    assert {(x[0], x[1]) for x in whole} == {(k, k) for k, _ in items}
    assert rows_of(d.contaminated(docs, spark.createDataFrame(items[::-1], ITEMS), d.LsiParams(pass_bytes=500))) == whole
    assert rows_of(d.contaminated(docs, spark.createDataFrame(items[7:9], ITEMS))) == [x for x in whole if x[1] in (7, 8)]


def synonyms(spark, kept: int):
    """A corpus of topics whose words come in pairs of synonyms, used at random; items, and paraphrases in synonyms but for the words from ``kept`` on and, with these, a few more."""
    r = random.Random(9)
    vocab = prose(77, 400).split()
    topics = [[(vocab[20 * k + 2 * i], vocab[20 * k + 2 * i + 1]) for i in range(10)] for k in range(20)]
    text = lambda k, n: [r.choice(r.choice(topics[k])) for _ in range(n)]
    rows = [row(1000 + i, " ".join(text(i % 20, 96))) for i in range(400)]
    items, other = [], []
    for k in range(20):
        picks = [(r.randrange(10), r.randrange(2)) for _ in range(24)]
        items.append((k, " ".join(topics[k][i][j] for i, j in picks)))
        other.append(row(k, " ".join(topics[k][i][j if n >= kept or (n % 6 == 0 and kept < 24) else 1 - j] for n, (i, j) in enumerate(picks))))
    return table(spark, rows + other), items


def test_the_latent_space_finds_paraphrases(spark):
    """Passages in synonyms that only the corpus links are candidates in the latent space, and aren't without it."""
    docs, items = synonyms(spark, 24)
    p = d.LsiParams(max_df=0.5, rank=24, bits=13)
    weights = d._frequencies(docs, p)
    space = d.latent_space(docs, weights, p)
    assert space.shape[1] == 24 and np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 1000").collect()}
    # Two words of one pair have nearly the same direction; words of different topics don't.
    found, plain = 0, 0
    for k, text in items:
        t = tv.tokenize(pa.array([texts[k]], pa.large_string()))
        one = d.items_of([(k, text, None)])
        *_, near = d.Index(one, weights, space, p).candidates(t)
        found += bool(near.any())
        # The identity in place of the space: the cosine of the vectors themselves.
        v = d.Index(one, weights, np.eye(1 << p.bits, dtype=np.float32)[:, np.unique(weights.features(np.concatenate((t.hashes, np.array(one[0].words, np.uint64)))))], p)
        *_, near = v.candidates(t)
        plain += bool(near.any())
    assert found >= 18 and plain == 0
    far = d.Index(d.items_of([(0, items[0][1], None)]), weights, space, p)
    assert not far.candidates(tv.tokenize(pa.array([texts[5]], pa.large_string())))[0].size


def test_latent_candidates_decide_with_the_answer(spark):
    """A paraphrase with the whole answer and little else in common is reported, which the words' overlap alone wouldn't do."""
    docs, items = synonyms(spark, 18)
    p = d.LsiParams(max_df=0.5, rank=24, bits=13)
    bench = spark.createDataFrame(items, ITEMS)
    got = {(x.doc_id, x.item_id): x.overlap for x in d.contaminated(docs.where("doc_id < 1000"), bench, d.LsiParams(max_df=0.5, latent=1.1, bits=13)).collect()}
    some = {(x.doc_id, x.item_id): x.overlap for x in d.contaminated(docs, bench, p).where("doc_id < 1000").collect()}
    new = [k for k in range(20) if (k, k) in some and (k, k) not in got]
    assert all(a == b for a, b in some) and any(some[k, k] < 0.55 for k in new)


def test_given_answers(spark):
    text = prose(11, 30)
    w = text.split()
    items = spark.createDataFrame([(1, text, w[3])], ITEMS + ", answer string")
    rows = [row(1, " ".join(w[:20])), row(2, " ".join(w[4:24]))]
    got = {(x.doc_id, x.answer) for x in d.contaminated(table(spark, rows), items, answer_col="answer").collect()}
    assert got == {(1, True)}


def test_odd_rows(spark):
    text = prose(12, 30)
    rows = odd_rows() + [row(40, text), row(40, text), row(None, text), row(41, prose(13, 50_000) + " " + text)]
    docs = table(spark, rows, clash=True)
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "?!"), (None, text)], ITEMS).selectExpr("*", "'x' as doc_id", "1 as rank")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in d.contaminated(docs, items).collect())
    each = [("40", "1")] * 4 + [("41", "1")] * 2 + [("None", "1")] * 2 + [("40", "None")] * 2 + [("41", "None"), ("None", "None")]
    assert got == sorted(each)
    left = d.decontaminated(docs, items)
    assert left.columns == docs.columns
    assert left.count() == docs.count() - 3
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(d.contaminated(none, items)) == [] and rows_of(d.contaminated(docs, spark.createDataFrame([], ITEMS))) == []
    assert d.decontaminated(docs, spark.createDataFrame([], ITEMS)).count() == docs.count()


def test_tokens_of_the_pattern(spark):
    assert [i.words for i in d.items_of([(1, "A b!", None)])] == [[tv.hash_word("a"), tv.hash_word("b")]]
    assert d.blocks(tv.tokenize(pa.array(["a b c", "", "d"], pa.large_string())), 2)[0].tolist() == [0, 0, 1, 2]
