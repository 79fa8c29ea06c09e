"""Benchmark decontamination by latent semantic retrieval.

Passages (two adjoining blocks of words) are TF-IDF vectors over the corpus's own hashed vocabulary. A distributed randomised SVD of the
corpus passages gives a latent space of a rank far below the number of benchmark items; items are folded into it afterwards, so that
neither the space nor any other item bears on an item's result. A passage is a candidate for an item by either of two cosines: that
between the item and the passage's part in the item's own words, or that of both in the latent space, where words that the corpus uses
in the same company are close. A longest common subsequence of the words and a check of the item's answer decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import without
from .common import dropped, lean, written


@dataclass(frozen=True)
class LsiParams:
    #: Words in a block; a passage is two adjoining blocks.
    block: int = 24
    #: The corpus's vocabulary is hashed into 2**bits features.
    bits: int = 15
    rank: int = 48
    oversample: int = 16
    #: Words in more than this share of the blocks carry no weight, but for the rarest ``always`` words of each item in its own words.
    max_df: float = 0.02
    always: int = 8
    #: Least cosine of an item (of up to a passage's length; less for longer ones) and the passage's part in its words.
    cosine: float = 0.55
    #: Least cosine in the latent space, and the least share of a vector's energy that the space must hold for that to count.
    latent: float = 0.85
    held: float = 0.25
    #: Share of an item's words in the longest common subsequence: enough alone, and enough where the answer is there too.
    lcs: float = 0.7
    lcs_with_answer: float = 0.55
    answer_lcs: float = 0.6
    #: A passage as near as ``latent`` with the whole answer needs only this share.
    lcs_latent: float = 0.35
    #: Bytes of benchmark text that are broadcast at once; more are searched in further passes, each item as it would be alone.
    pass_bytes: int = 16 << 20
    seed: int = 5


def lcs(marks: list[int], n: int) -> int:
    """Length of the longest common subsequence of a pattern of n words and a text given by each word's bit mask of places in the pattern (bit-parallel)."""
    full = (1 << n) - 1
    v = full
    for m in marks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def bit_masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def window(n: int) -> tuple[int, int]:
    """Words in a stretch that a pattern of n words is compared with, and the step from one to the next."""
    return n + -(-n // 4), max(1, n // 4)


def best_overlap(n: int, masks: dict[int, int], words: list[int], least: float = 0.0) -> float:
    """The largest share of a pattern of n words in a common subsequence with a stretch of words hardly longer than it; 0 if that is less than ``least``.

    A stretch with no more of the pattern's words than the best so far, or than ``least`` asks for, can't do better and is passed over.
    """
    span, stride = window(n)
    marks = [masks.get(w, 0) for w in words]
    have = [0, *accumulate(1 if m else 0 for m in marks)]
    floor = needed(n, least)
    best = 0
    for a in range(0, max(1, len(words) - span + stride), stride):
        b = min(a + span, len(words))
        most = have[b] - have[a]
        if most > best and most >= floor:
            best = max(best, lcs([m for m in marks[a:b] if m], n))
            if best == n:
                break
    return best / n if best >= floor else 0.0


def needed(n: int, share: float) -> int:
    """Least whole number of n words that is at least the share."""
    return int(np.ceil(share * n - 1e-9))


@dataclass(frozen=True)
class Item:
    key: object
    words: list[int]
    masks: dict[int, int]
    answer: list[int]
    answer_masks: dict[int, int]


def items_of(rows: list[tuple[object, str | None, str | None]]) -> list[Item]:
    """Items with words. The answer is the given one or else the item's last quarter (at least four words)."""
    out = []
    for key, text, answer in rows:
        w = [int(h) for h in tv.tokenize(pa.array([text or ""], pa.large_string())).hashes]
        if not w:
            continue
        a = [int(h) for h in tv.tokenize(pa.array([answer or ""], pa.large_string())).hashes] or w[-max(4, len(w) // 4) :]
        out.append(Item(key, w, bit_masks(w), a, bit_masks(a)))
    return out


def blocks(t: tv.Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of every token, and the first block of every text (one more entry for the end)."""
    per = -(-t.counts // size)
    first = np.concatenate(([0], np.cumsum(per)))
    inside = np.arange(len(t.hashes)) - np.repeat(t.offsets[:-1], t.counts)
    return np.repeat(first[:-1], t.counts) + inside // size, first


class Vocabulary:
    """Sorted hashes with a quick test that most words fail."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[hashes >> np.uint64(46)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in h words of the vocabulary are, and which."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[h >> np.uint64(46)])
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[slot] == h[at]
        return at[hit], slot[hit]


def sum_rows(table: np.ndarray, index: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows table[index] by ascending group, and the groups; the k-th rows of all groups are added at once."""
    first = tv.starts_of(group)
    sizes = np.diff(np.append(first, len(group)))
    order = np.argsort(-sizes, kind="stable")
    at, sizes = first[order], sizes[order]
    total = table[index[at]]
    steps = min(64, int(sizes[0]) if len(sizes) else 0)
    for k in range(1, steps):
        m = int(np.searchsorted(-sizes, -k, side="left"))
        total[:m] += table[index[at[:m] + k]]
    for j in range(int(np.searchsorted(-sizes, -64, side="left"))):  # the few long ones
        total[j] += table[index[at[j] + 64 : at[j] + sizes[j]]].sum(axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out, group[first]


def joined(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages: the first block of each, and whether the next block belongs to it too (it does but in texts of one block)."""
    per = np.diff(first)
    last = np.zeros(int(first[-1]), bool)
    last[first[1:][per > 0] - 1] = True
    alone = np.zeros(len(last), bool)
    alone[first[:-1][per == 1]] = True
    start = np.flatnonzero(~last | alone)
    return start, ~alone[start]


class Weights:
    """Inverse document frequencies of the hashed vocabulary, from its frequencies in blocks; 0 for features that are too frequent."""

    def __init__(self, df: np.ndarray, total: int, p: LsiParams):
        self.p, self.df, self.total = p, df, total
        self.shift = np.uint64(64 - p.bits)
        self.idf = np.log(1 + total / np.maximum(df, 0.5)).astype(np.float32)
        self.live = np.where(df <= p.max_df * total, self.idf, np.float32(0))

    def features(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.uint16 if self.p.bits <= 16 else np.int64)

    def item(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """An item's distinct words that the corpus has, and their energies: squared TF-IDF."""
        w, tf = np.unique(np.array(words, np.uint64), return_counts=True)
        w, tf = w[self.df[self.features(w)] > 0], tf[self.df[self.features(w)] > 0]
        f = self.features(w)
        use = self.live[f] > 0
        use[np.lexsort((w, self.df[f]))[: self.p.always]] = True
        return w[use], (tf[use] * self.idf[f[use]].astype(float)) ** 2


def _frequencies(d: DataFrame, p: LsiParams) -> Weights | None:
    """Number of blocks that hold each hashed feature, over all words of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(1 << p.bits, np.int64), 0
        shift = np.uint64(64 - p.bits)
        for b in batches:
            column = tv.strings(b.column("text"))
            for i, j in tv.chunks(column):
                t = tv.tokenize(column.slice(i, j - i))
                of, first = blocks(t, p.block)
                total += int(first[-1])
                key = (of << p.bits) | (t.hashes >> shift).astype(np.int64)
                key.sort()
                df += np.bincount(key[tv.starts_of(key)] & ((1 << p.bits) - 1), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], ["feature", "n"])

    got = {r[0]: r[1] for r in d.select("text").mapInArrow(lean(run), "feature long, n long").groupBy("feature").agg(F.sum("n")).collect()}
    total = got.pop(-1, 0)
    if not total:
        return None
    df = np.zeros(1 << p.bits)
    df[list(got)] = list(got.values())
    return Weights(df, total, p)


def latent_space(d: DataFrame, weights: Weights, p: LsiParams) -> np.ndarray:
    """(features x rank) orthonormal directions of the most energy among the TF-IDF passages A of d: those of A'A omega, omega random.

    Each task adds up its share of A'A omega; the shares are summed in a tree, so that no group holds more than ``fan`` of them.
    """
    spark, width, slab, fan = d.sparkSession, p.rank + p.oversample, 64, 64
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        omega = np.random.default_rng(p.seed).standard_normal((1 << p.bits, width), np.float32) * w.live[:, None]
        z = np.zeros_like(omega)
        for b in batches:
            column = tv.strings(b.column("text"))
            for i, j in tv.chunks(column):
                t = tv.tokenize(column.slice(i, j - i))
                of, first = blocks(t, p.block)
                f = w.features(t.hashes)
                at = np.flatnonzero(w.live[f])
                if not len(at):
                    continue
                f, of = f[at], of[at]
                y, group = sum_rows(omega, f, of)
                whole = np.zeros((int(first[-1]), width), np.float32)
                whole[group] = y
                # What the passages that hold a block give in all: each passage's sum once for each of its blocks.
                start, two = joined(first)
                pair, one = start[two], start[~two]
                sums = whole[pair] + whole[pair + 1]
                back = np.zeros_like(whole)
                back[one] = whole[one]
                back[pair] += sums
                back[pair + 1] += sums
                order = np.argsort(f, kind="stable")
                part, which = sum_rows(back, of[order], f[order])
                z[which] += part
        z *= w.live[:, None]
        n = -(-len(z) // slab)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, task)), pa.array(range(n), pa.int32()), pa.array([z[k * slab : (k + 1) * slab].tobytes() for k in range(n)], pa.binary())], ["part", "slab", "z"])

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(len(group.column("z")[0].as_py()) // 4)
        for x in group.column("z").to_pylist():
            total += np.frombuffer(x, np.float32)
        return pa.table({"part": group.column("part").slice(0, 1), "slab": group.column("slab").slice(0, 1), "z": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    sums, path = written(d.select("text").mapInArrow(lean(run), "part long, slab int, z binary"), "sketch")
    parts = sums.agg(F.max("part")).first()[0] or 0
    while parts > 0:
        sums = sums.withColumn("part", F.floor(F.col("part") / fan)).groupBy("slab", "part").applyInArrow(added, "part long, slab int, z binary")
        parts //= fan
    z = np.concatenate([np.frombuffer(r["z"], np.float32).reshape(-1, width) for r in sorted(sums.select("slab", "z").collect(), key=lambda r: r["slab"])]).astype(np.float64)
    dropped(spark, path)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    return u[:, : p.rank][:, s[: p.rank] > 1e-9 * max(float(s[0]), 1e-30)].astype(np.float32)


class Index:
    """Items folded into the corpus's space: nothing in it depends on more than one item."""

    def __init__(self, items: list[Item], weights: Weights, space: np.ndarray, p: LsiParams):
        self.items, self.weights, self.p = items, weights, p
        self.basis = space * weights.live[:, None]
        own = [weights.item(x.words) for x in items]
        self.vocab = Vocabulary(np.unique(np.concatenate([np.array(x.words, np.uint64) for x in items])))
        n = len(self.vocab.hashes)
        slot = [np.searchsorted(self.vocab.hashes, w) for w, _ in own]
        self.sizes = np.array([len(x.words) for x in items])
        # Postings of the vocabulary: the items that a word belongs to, with its share of the item's energy.
        word = np.concatenate(slot)
        item = np.repeat(np.arange(len(items)), [len(x) for x in slot])
        share = np.concatenate([e / max(e.sum(), 1e-30) for _, e in own])
        order = np.lexsort((item, word))
        self.post_item, self.post_share = item[order], share[order]
        self.post = np.searchsorted(word[order], np.arange(n + 1))
        self.least = (p.cosine**2) * np.minimum(1.0, 2 * p.block / self.sizes) - 1e-9
        #: All (item, word) pairs, to tell whether a word is one of an item's.
        self.owned = np.unique(np.concatenate([np.unique(np.searchsorted(self.vocab.hashes, np.array(x.words, np.uint64))) + k * n for k, x in enumerate(items)]))
        fold = np.zeros((len(items), space.shape[1]), np.float32)
        held = np.zeros(len(items), bool)
        for k, x in enumerate(items):
            f, tf = np.unique(weights.features(np.array(x.words, np.uint64)), return_counts=True)
            v = self.basis[f].T @ tf.astype(np.float32)
            fold[k] = v
            held[k] = float(v @ v) >= p.held * max(1e-12, float(((tf * weights.live[f]) ** 2).sum()))
        self.folded = np.flatnonzero(held)
        self.target = np.ascontiguousarray((fold[held] / np.maximum(np.linalg.norm(fold[held], axis=1, keepdims=True), 1e-12)).T)

    def belongs(self, item: np.ndarray, slot: np.ndarray) -> np.ndarray:
        key = item * len(self.vocab.hashes) + slot
        at = np.minimum(np.searchsorted(self.owned, key), len(self.owned) - 1)
        return self.owned[at] == key

    def candidates(self, t: tv.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first block, item, cosine (the larger one) and whether it is that of the latent space, for each passage near an item."""
        p, w = self.p, self.weights
        of, first = blocks(t, p.block)
        start, two = joined(first)
        passages, n_items = len(start), len(self.items)
        number = np.cumsum(np.bincount(start, minlength=int(first[-1]))) - 1  # of the passage that begins with a block
        keys, values, latent = [], [], []
        # The passage's part in the item's words: distinct words of each passage, then each word's items.
        at, slot = self.vocab.find(t.hashes)
        some = self.post[slot + 1] > self.post[slot]
        at, slot = at[some], slot[some]
        if len(at):
            n = len(self.vocab.hashes)
            b = of[at]
            begins = np.zeros(int(first[-1]) + 1, bool)
            begins[start] = True
            ends = np.zeros(int(first[-1]) + 1, bool)
            ends[start[two] + 1] = True
            pair = np.concatenate((number[b[begins[b]]] * n + slot[begins[b]], number[b[ends[b]] - 1] * n + slot[ends[b]]))
            pair = np.unique(pair)
            passage, word = pair // n, pair % n
            many = self.post[word + 1] - self.post[word]
            place = np.repeat(self.post[word] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
            key = np.repeat(passage, many) * n_items + self.post_item[place]
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = tv.starts_of(key)
            share = np.add.reduceat(self.post_share[place][order], starts)
            key = key[starts]
            ok = share >= self.least[key % n_items]
            keys.append(key[ok])
            values.append(np.sqrt(np.minimum(share[ok], 1.0)))
            latent.append(np.zeros(int(ok.sum()), bool))
        f = w.features(t.hashes)
        at = np.flatnonzero(w.live[f])
        if len(at) and len(self.folded) and self.basis.shape[1]:
            energy = np.bincount(of[at], weights=w.live[f[at]].astype(float) ** 2, minlength=int(first[-1]) + 1)
            y, group = sum_rows(self.basis, f[at], of[at])
            whole = np.zeros((int(first[-1]) + 1, self.basis.shape[1]), np.float32)
            whole[group] = y
            follow = np.where(two, start + 1, len(whole) - 1)  # the last row is empty
            v = whole[start] + whole[follow]
            norm = np.einsum("ij,ij->i", v, v)
            enough = np.flatnonzero((norm >= p.held * (energy[start] + energy[follow])) & (norm > 0))
            for a in range(0, len(enough), 4096):
                rows = enough[a : a + 4096]
                sims = (v[rows] / np.sqrt(norm[rows])[:, None]) @ self.target
                r, k = np.nonzero(sims >= p.latent)
                keys.append(rows[r] * n_items + self.folded[k])
                values.append(sims[r, k].astype(float))
                latent.append(np.ones(len(r), bool))
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        value = np.concatenate(values) if keys else np.zeros(0)
        near = np.concatenate(latent) if keys else np.zeros(0, bool)
        order = np.lexsort((near, key))
        key, value, near = key[order], value[order], near[order]
        at = tv.starts_of(key)
        if len(at):
            value, near = np.maximum.reduceat(value, at), np.logical_or.reduceat(near, at)
            key = key[at]
        block = start[key // n_items] if len(key) else key
        text = np.searchsorted(first, block, side="right") - 1
        return text, block - first[text], key % n_items, value, near

    def possible(self, slots: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Which of the hits (words lo to hi, item) have a stretch with enough of the item's words for the share of it; an upper bound of the overlap.

        slots: the vocabulary's number of each word, -1 for others.
        """
        keep = np.zeros(len(item), bool)
        floor = np.ceil(share * self.sizes[item] - 1e-9).astype(np.int64)
        span = self.sizes[item] + -(-self.sizes[item] // 4)
        a = 0
        while a < len(item):
            width = int((hi[a : a + 4096] - lo[a : a + 4096]).max())
            b = min(len(item), a + max(1, min(4096, (1 << 21) // max(1, width))))
            k, low, high = item[a:b], lo[a:b], hi[a:b]
            at = low[:, None] + np.arange(width)
            s = np.where(at < high[:, None], slots[np.minimum(at, len(slots) - 1)], -1)
            hits = np.zeros(s.shape, bool)
            r, c = np.nonzero(s >= 0)
            hits[r, c] = self.belongs(k[r], s[r, c])
            some = np.flatnonzero(hits.sum(axis=1) >= floor[a:b])
            if len(some):
                sums = np.zeros((len(some), width + 1), np.int32)
                np.cumsum(hits[some], axis=1, out=sums[:, 1:])
                ends = np.minimum(np.arange(width) + span[a + some, None], width)
                most = (np.take_along_axis(sums, ends, axis=1) - sums[:, :-1]).max(axis=1)
                keep[a + some] = most >= floor[a + some]
            a = b
        return keep

    def decide(self, t: tv.Tokens) -> list[tuple[int, int, float, float, bool]]:
        """(text, item, cosine, overlap, answer) of the candidates that hold their item."""
        p = self.p
        text, block, item, cosine, near = self.candidates(t)
        if not len(text):
            return []
        least = min(p.lcs, p.lcs_with_answer)
        share = np.where(near, min(least, p.lcs_latent), least)
        low, high = t.offsets[:-1][text], t.offsets[1:][text]
        lo, hi = np.maximum(low, low + block * p.block - self.sizes[item]), np.minimum(high, low + (block + 2) * p.block + self.sizes[item])
        slots = np.full(len(t.hashes), -1, np.int64)
        known, slot = self.vocab.find(t.hashes)
        slots[known] = slot
        maybe = np.flatnonzero(self.possible(slots, lo, hi, item, share))
        found: dict[tuple[int, int], list[int]] = {}
        for c in maybe.tolist():
            found.setdefault((int(text[c]), int(item[c])), []).append(c)
        out = []
        for (tx, k), places in sorted(found.items()):
            it = self.items[k]
            best = (False, 0.0, False, 0.0)
            for c in places:
                words = t.hashes[lo[c] : hi[c]].tolist()
                over = best_overlap(len(it.words), it.masks, words, float(share[c]))
                if over > 0:
                    answer = best_overlap(len(it.answer), it.answer_masks, words)
                    yes = over >= p.lcs or (over >= p.lcs_with_answer and answer >= p.answer_lcs) or (bool(near[c]) and over >= p.lcs_latent and answer >= 1.0)
                    best = max(best, (yes, over, answer >= p.answer_lcs, float(cosine[c])))
            if best[0]:
                out.append((tx, k, round(max(float(cosine[c]) for c in places), 4), round(best[1], 6), best[2]))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, p: LsiParams = LsiParams(), id_col: str = "item_id", answer_col: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer): each document with each benchmark item that it contains, verbatim or in other words.

    ``overlap`` is the share of the item's words in the longest common subsequence; ``answer`` says whether the answer is there: that of
    ``answer_col`` or, without one, the item's last quarter. Documents and items that are null, empty or without words match nothing;
    rows with a null doc_id are searched and reported with null; repeated rows are reported each, as are repeated items; where
    several passages hold an item, the one of the largest overlap counts; an empty benchmark or corpus gives an empty result. Texts of
    any length are searched whole. Other columns are not read. An item's rows don't depend on the other items or their order. The
    benchmark is broadcast in passes of at most ``pass_bytes`` of text; frequencies and space are made once.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = benchmark.schema[id_col].dataType.simpleString()
    schema = f"doc_id long, `{id_col}` {kind}, cosine double, overlap double, answer boolean"
    empty = spark.createDataFrame([], schema)
    id_name, key_type = empty.columns[1], empty.toArrow().schema.field(1).type
    asked = benchmark.select(F.col(id_col).alias("key"), F.col("text").cast("string").alias("text"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    asked = asked.where("text is not null and text != ''")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return empty
    weights = _frequencies(d, p)
    if weights is None:
        return empty
    space = latent_space(d, weights, p)
    passes = -(-int(size) // p.pass_bytes)
    out = empty
    for k in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("key", "text"), F.lit(passes)) == k).collect() if passes > 1 else asked.collect()
        items = items_of(sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), str(r[1]))))
        if not items:
            continue
        shared = spark.sparkContext.broadcast(Index(items, weights, space, p))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                column = tv.strings(b.column("text"))
                got = [(i + tx, *rest) for i, j in tv.chunks(column) for tx, *rest in index.decide(tv.tokenize(column.slice(i, j - i)))]
                rows, keys, cosines, overlaps, answers = zip(*got, strict=True) if got else ((),) * 5
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([index.items[x].key for x in keys], key_type), pa.array(cosines, pa.float64()), pa.array(overlaps, pa.float64()), pa.array(answers, pa.bool_())], ["doc_id", id_name, "cosine", "overlap", "answer"])

        found = d.mapInArrow(lean(search), schema)
        out = found if out is empty else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, p: LsiParams = LsiParams(), id_col: str = "item_id") -> DataFrame:
    """docs without the documents that contain a benchmark item; all columns stay, whatever their names.

    Rows with a null doc_id stay, as do null, empty and blank texts; of rows that repeat a doc_id all go if one contains an item; an
    empty benchmark or table changes nothing. Texts of any length are searched whole; ties are as in ``contaminated``.
    """
    gone, _ = written(contaminated(docs, benchmark, p, id_col).where("doc_id is not null").select("doc_id").distinct(), "leaks")
    return without(docs, gone)
