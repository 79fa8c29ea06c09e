"""Nearest-neighbour joins: exact over blocks, coarse then exact, and by cells.

Each task ranks its share of the queries, as many shares as keep the cluster busy, and reads all of the base past them block by block. Blocks
are multiplied as matrices in single precision; what the error bound of these products leaves is scored in double precision, and each query's
k best so far bound the next blocks. What is shuffled is each query and each row of the base once, never scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.arrow import matrix
from glossa.operators.codecs import assign, kmeans

METRICS = ("cosine", "ip", "l2")
PLACES = 6
#: Vectors of a block at most, and their bytes; queries that are multiplied with a block at once.
ROWS, BYTES, PART = 4096, 1 << 21, 1024
#: Numbers that candidates are scored from at once; candidates for each place that a block may leave before they are counted more exactly.
NUMBERS, MANY = 1 << 21, 4


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer; l2 is the negative distance. A zero vector has cosine 0."""
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    if metric == "l2":
        return -np.sqrt(np.maximum((q**2).sum(1)[:, None] - 2 * q @ v.T + (v**2).sum(1), 0))
    return q @ v.T


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest scores (to PLACES places), ties by id; -inf never counts."""
    r = -np.round(s, PLACES)
    if s.shape[1] > k:
        rows, cols = np.nonzero((r <= np.partition(r, k - 1, axis=1)[:, k - 1 : k]) & (r < np.inf))
    else:
        rows, cols = np.nonzero(r < np.inf)
    order = np.lexsort((ids[cols], r[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


def packed(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` rows of df, whose first column is an id, perhaps a cell follows, and vectors: each column's values together as little-endian int64 or float64, and the block's number. No shuffle."""
    names, kinds = df.columns, [kind.startswith("array") for _, kind in df.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = most = 0

        def flush() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names)

        for b in batches:
            if not b.num_rows:
                continue
            columns = [matrix(c) if vector else c.to_numpy().astype(np.int64) for c, vector in zip(b.columns, kinds, strict=True)]
            most = most or max(1, min(rows, BYTES // (8 * max(1, *(x.shape[1] for x in columns if x.ndim == 2)))))
            at = 0
            while at < b.num_rows:
                n = min(most - size, b.num_rows - at)
                held.append([x[at : at + n] for x in columns])
                size, at = size + n, at + n
                if size == most:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    got = df.where(" and ".join(f"`{c}` is not null" for c in names)).mapInArrow(run, ", ".join(f"`{c}` binary" for c in names))
    return got.withColumn("number", F.monotonically_increasing_id())


def rounded(x: np.ndarray) -> np.ndarray:
    """To PLACES places, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**PLACES + 0.5), x) / 10.0**PLACES


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Base:
    """Rows that are compared with queries; those whose length is no finite number are left out.

    ``forms``: what queries are multiplied with, in single and in double precision, with the bound of the products' error as a share of the
    vectors' lengths. For l2 these are inner products less half the row's squared length.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, metric: str, exact: np.ndarray | None = None):
        length = np.linalg.norm(x, axis=1)
        fine = np.isfinite(length * length)
        self.ids, self.x, self.exact = ids[fine], x[fine], None if exact is None else exact[fine]
        self.far = float(length[fine].max(initial=0.0))
        if metric == "cosine":
            self.x, self.far = unit(self.x), 1.0
        form = self.x.T if metric != "l2" else np.vstack((self.x.T, -0.5 * (self.x**2).sum(1)))
        kinds = [np.float32, np.float64] if self.far < 1e15 else [np.float64]
        self.forms = [(np.ascontiguousarray(form, t), (form.shape[0] + 16) * float(np.finfo(t).eps)) for t in kinds]
        self.by = np.argsort(self.ids, kind="stable")
        self.sorted = self.ids[self.by]


class Nearest:
    """The k best rows of each query of a block, of all that were added: ascending by score (to PLACES places, larger is nearer), then by id.

    exact: vectors in whose form the best rows are scored as well.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str, keep_self: bool = False, exact: np.ndarray | None = None):
        self.ids, self.k, self.metric, self.keep_self, self.exact = ids, k, metric, keep_self, exact
        self.x = unit(x) if metric == "cosine" else x
        self.length = np.ones(len(x)) if metric == "cosine" else np.linalg.norm(x, axis=1)
        form = self.x if metric != "l2" else np.hstack((self.x, np.ones((len(x), 1))))
        narrow = not len(x) or float(np.nan_to_num(self.length, nan=0.0).max()) < 1e15
        self.forms = {np.dtype(t): form.astype(t) for t in ((np.float32, np.float64) if narrow else (np.float64,))}
        self.score, self.found = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64)
        self.second = None if exact is None else np.zeros((len(x), k))
        self.more: list[tuple[np.ndarray, ...]] = []

    def add(self, v: Base, rows: np.ndarray | None = None) -> None:
        """rows: the queries that the base is for, if not for all."""
        if not len(v.ids):
            return
        rows = np.arange(len(self.ids)) if rows is None else rows
        for a in range(0, len(rows), PART):
            at = rows[a : a + PART]
            for form, share in v.forms:
                if form.dtype in self.forms:
                    hit = self._hits(v, at, form, share)
                    if len(hit) <= MANY * self.k * len(at):
                        break
            self._take(v, at, hit)

    def _hits(self, v: Base, at: np.ndarray, form: np.ndarray, share: float) -> np.ndarray:
        """Places in the matrix of queries and rows that may be among the k best."""
        s = self.forms[form.dtype][at] @ form
        length, last, near = self.length[at], self.score[at, -1], 10.0**-PLACES
        if not self.keep_self:
            lo, hi = (np.searchsorted(v.sorted, self.ids[at], side) for side in ("left", "right"))
            own = np.flatnonzero(lo < hi)
            n = (hi - lo)[own]
            s[np.repeat(own, n), v.by[np.repeat(lo[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = -np.inf
        if self.metric == "l2":
            error, limit, slack = share * (length * v.far + v.far**2), (length**2 - (near - last) ** 2) / 2, near * (length + v.far) + near**2
        else:
            error, limit, slack = share * length * v.far, last - near, near
        limit = limit - error
        hit = self._above(s, limit)
        if len(hit) > MANY * self.k * len(at) and s.shape[1] > self.k:
            kth = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1].astype(float)
            hit = self._above(s, np.fmax(limit, kth - 2 * error - slack))
        return hit

    @staticmethod
    def _above(s: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return np.flatnonzero((s >= np.nextafter(limit.astype(s.dtype), s.dtype.type(-np.inf))[:, None]).ravel())

    def _take(self, v: Base, at: np.ndarray, hit: np.ndarray) -> None:
        """Score candidates as exactly as they are reported."""
        step = max(1, NUMBERS // max(1, v.x.shape[1]))
        for a in range(0, len(hit), step):
            r, c = np.divmod(hit[a : a + step], len(v.ids))
            r, ids = at[r], v.ids[c]
            x, y = self.x[r], v.x[c]
            s = rounded(-np.linalg.norm(x - y, axis=1) if self.metric == "l2" else np.einsum("ij,ij->i", x, y))
            last = self.score[r, -1]
            ok = (s > last) | ((s == last) & (s > -np.inf) & (ids < self.found[r, -1]))
            if not self.keep_self:
                ok &= self.ids[r] != ids
            r, s, ids = r[ok], s[ok], ids[ok]
            rest = ()
            if self.second is not None:
                x, y = self.exact[r], v.exact[c[ok]]
                rest = (rounded(-np.linalg.norm(x - y, axis=1) if self.metric == "l2" else np.einsum("ij,ij->i", x, y)),)
            self.more.append((r, s, ids, *rest))
            if sum(len(m[0]) for m in self.more) >= self.score.size:
                self.settle()

    def settle(self) -> None:
        """Rank what was found since the last time with what was found before."""
        if not self.more:
            return
        new = [np.concatenate(x) for x in zip(*self.more, strict=True)]
        self.more = []
        touched = np.zeros(len(self.ids), bool)
        touched[new[0]] = True
        row, place = np.nonzero((self.score > -np.inf) & touched[:, None])
        tables = [self.score, self.found] + ([] if self.second is None else [self.second])
        r, s, ids, *rest = (np.concatenate(x) for x in zip((row, *(t[row, place] for t in tables)), new, strict=True))
        order, place = _places(r, ids, s, self.k)
        self.score[touched] = -np.inf
        for table, x in zip(tables, (s, ids, *rest), strict=True):
            table[r[order], place] = x[order]

    def rows(self) -> list[np.ndarray]:
        """(query's id, id, score[, exact score]) of all that was kept."""
        self.settle()
        row, place = np.nonzero(self.score > -np.inf)
        return [self.ids[row], *(t[row, place] for t in (self.found, self.score, self.second) if t is not None)]


def _places(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of each group's k largest scores, ties by id, and their places from 0."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    keep = place < k
    return order[keep], place[keep]


def _shares(queries: DataFrame, base: DataFrame, start: Callable[[list[np.ndarray]], tuple[Nearest, object]], read: Callable[[list[np.ndarray]], object], add: Callable[[Nearest, object, object], None], k: int, wide: int, rows: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query of all that ``add`` gives it; with exact scores, the k best by these of its ``wide`` best.

    queries and base are tables of an id, perhaps a cell, and vectors. start makes a block of queries, with what add wants to know of it, and
    read a block of the base. Rows of one query id are in one task, which reads all of the base.
    """
    spark = queries.sparkSession
    q = packed(queries.repartition(4 * spark.sparkContext.defaultParallelism, queries.columns[0]), rows)
    v = packed(base, rows).repartition(1)
    names = [[f"{side}{i}" for i in range(len(df.columns))] for side, df in (("v", v), ("q", q))]
    pairs = v.toDF(*names[0]).hint("shuffle_replicate_nl").crossJoin(q.toDF(*names[1]))
    vectors = [[kind.startswith("array") for _, kind in df.dtypes] for df in (base, queries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[Nearest, object]] = {}
        number, rest = None, None

        def unpacked(b: pa.RecordBatch, i: int, first: int, kinds: list[bool]) -> list[np.ndarray]:
            parts = [np.frombuffer(b.column(first + k)[i].as_buffer(), np.float64 if vector else np.int64) for k, vector in enumerate(kinds)]
            return [x.reshape(len(parts[0]), -1) if vector else x for x, vector in zip(parts, kinds, strict=True)]

        for b in batches:
            numbers = [b.column(i).to_pylist() for i in (len(names[0]) - 1, b.num_columns - 1)]
            for i, (vn, qn) in enumerate(zip(*numbers, strict=True)):
                if vn != number:  # the base is the outer loop: its block's turn is over for good
                    number, rest = vn, read(unpacked(b, i, 0, vectors[0]))
                if qn not in blocks:
                    blocks[qn] = start(unpacked(b, i, len(names[0]), vectors[1]))
                add(*blocks[qn], rest)
            del b
        if not blocks:
            return
        rest = None
        q, ids, score, *exact = (np.concatenate(x) for x in zip(*(n.rows() for n, _ in blocks.values()), strict=True))
        blocks.clear()
        order, place = _places(q, ids, score, wide)
        if exact:
            q, ids, score = q[order], ids[order], exact[0][order]
            order, place = _places(q, ids, score, k)
        for a in range(0, len(order), 1 << 16):
            at = order[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[at], place[a : a + (1 << 16)] + 1, ids[at], score[at])], ["query_id", "rank", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, rank long, vec_id long, score double").withColumn("score", F.round("score", PLACES))


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest scores by query, ties by vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", PLACES).desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("score", PLACES).alias("score"))


def knn(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", keep_self: bool = False, rows: int = ROWS) -> DataFrame:
    """Exact k nearest rows of base for every row of queries; a row isn't its own neighbour unless keep_self. Distances for l2."""
    q, v = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x")) for df in (queries, base))
    out = _shares(q, v, lambda x: (Nearest(*x, k, metric, keep_self), None), lambda x: Base(*x, metric), lambda near, _, block: near.add(block), k, k, rows)
    return out.withColumn("score", -F.col("score")) if metric == "l2" else out


def rerank(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact scores of candidate pairs (query_id, vec_id) and the k best of each query."""
    both = candidates.select("query_id", "vec_id").join(queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("_q")), "query_id").join(base.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("_v")), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, v = matrix(b.column(2)), matrix(b.column(3))
                if metric == "cosine":
                    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                s = -np.linalg.norm(q - v, axis=1) if metric == "l2" else (q * v).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["query_id", "vec_id", "score"])

    return ranked(both.select("query_id", "vec_id", "_q", "_v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def refine(queries: DataFrame, base: DataFrame, k: int, factor: int, coarse: Column | tuple[Column, Column], metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", rows: int = ROWS) -> DataFrame:
    """Two stages: the k * factor nearest by a coarse form of the vectors, ranked exactly.

    Blocks hold both forms: a row that comes among the coarsely nearest is scored exactly at once, so that no vector is joined to a pair
    afterwards. coarse may be two columns, of queries and of base.
    """
    left, right = coarse if isinstance(coarse, tuple) else (coarse, coarse)
    q, v = (df.select(F.col(id_col).cast("long").alias("id"), form.alias("c"), F.col(vec_col).alias("x")) for df, form in ((queries, left), (base, right)))
    fine = unit if metric == "cosine" else lambda x: x
    return _shares(
        q,
        v,
        lambda x: (Nearest(x[0], x[1], k * factor, metric, exact=fine(x[2])), None),
        lambda x: Base(x[0], x[1], metric, fine(x[2])),
        lambda near, _, block: near.add(block),
        k,
        k * factor,
        rows,
    )


def centroids(df: DataFrame, cell_col: str, vec_col: str = "embedding") -> DataFrame:
    """(cell, centroid): means of the vectors by cell; each task adds up its vectors by cell before they are summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                cell, x = b.column(0).to_numpy(), matrix(b.column(1))
                names, of = np.unique(cell, return_inverse=True)
                part = np.zeros((len(names), x.shape[1] + 1))
                np.add.at(part[:, :-1], of, x)
                part[:, -1] = np.bincount(of)
                for k, p in zip(names.tolist(), part, strict=True):
                    sums[k] = sums[k] + p if k in sums else p
        if sums:
            cells, parts = np.array(list(sums)), np.array(list(sums.values()))
            d = parts.shape[1] - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cells, d)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(cells))), pa.array(parts[:, :-1].ravel()), pa.array(np.repeat(parts[:, -1], d))], ["cell", "dim", "s", "n"])

    some = df.select(F.col(cell_col).cast("long").alias("cell"), vec_col).where(F.col(vec_col).isNotNull() & F.col("cell").isNotNull())
    means = some.mapInArrow(run, "cell long, dim int, s double, n double").groupBy("cell", "dim").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"]).alias("centroid"))


def train_cells(df: DataFrame, cells: int, steps: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(cell, centroid) by Lloyd's algorithm over all vectors; as many cells as asked for must fit a broadcast."""
    c = kmeans((df, id_col, vec_col), cells, steps)
    return df.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell long, centroid array<double>")


def assigned(df: DataFrame, cells: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """df's (id, vector) with the cell whose centroid is nearest, the first of equals; one narrow pass."""
    rows = sorted(cells.collect(), key=lambda r: r["cell"])
    names, c = np.array([r["cell"] for r in rows]), np.array([r["centroid"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[assign(matrix(b.column(1)), c)])], [id_col, vec_col, "cell"])

    some = df.select(id_col, vec_col).where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    return some.mapInArrow(run, f"`{id_col}` long, `{vec_col}` {df.schema[vec_col].dataType.simpleString()}, cell long")


def _cells(x: list[np.ndarray]) -> list[tuple[int, Base]]:
    """A block's rows by cell, from (ids, cells, vectors)."""
    ids, cell, v = x
    order = np.argsort(cell, kind="stable")
    return [(int(cell[at[0]]), Base(ids[at], v[at], "cosine")) for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)]


def ivf(queries: DataFrame, base: DataFrame, cells: DataFrame, cell_col: str | None, k: int, nprobe: int, id_col: str = "vec_id", vec_col: str = "embedding", rows: int = ROWS, split: int = 8) -> DataFrame:
    """k best by cosine among the rows of the nprobe cells whose centroids have the largest inner product with the query.

    base's cells are those of ``cell_col`` or, without one, the nearest. Blocks of the base hold rows of one cell or of few, a block's rows
    are compared with those queries only that probe their cell, and no query is sent to its cells. A hot cell's blocks are made by
    ``split`` tasks.
    """
    c = sorted(cells.collect(), key=lambda r: r["cell"])
    names, centres = np.array([r["cell"] for r in c], np.int64), np.array([r["centroid"] for r in c], float)

    def start(x: list[np.ndarray]) -> tuple[Nearest, dict[int, np.ndarray]]:
        """The queries, and those that probe each cell."""
        probes, step = [], max(1, NUMBERS // max(1, len(names)))
        for a in range(0, len(x[0]) if len(names) else 0, step):
            r, at = best(scores(x[1][a : a + step], centres, "ip"), names, nprobe)
            probes.append((names[at], r + a))
        cell, r = (np.concatenate([np.zeros(0, np.int64), *p]) for p in zip(*probes, strict=True)) if probes else (np.zeros(0, np.int64),) * 2
        order = np.argsort(cell, kind="stable")
        some, first = np.unique(cell[order], return_index=True)
        return Nearest(*x, k, "cosine"), dict(zip(some.tolist(), np.split(r[order], first[1:]), strict=True)) if len(some) else {}

    def add(near: Nearest, probing: dict[int, np.ndarray], blocks: list[tuple[int, Base]]) -> None:
        for cell, block in blocks:
            if cell in probing:
                near.add(block, probing[cell])

    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
    member = base if cell_col else assigned(base, cells, id_col, vec_col)
    v = member.select(F.col(id_col).cast("long").alias("id"), F.col(cell_col or "cell").cast("long").alias("cell"), F.col(vec_col).alias("x")).where("id is not null and cell is not null and x is not null")
    placed = v.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(split))).sortWithinPartitions("cell")
    return _shares(q, placed, start, _cells, add, k, k, rows)


def label_vote(neighbours: DataFrame, labels: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(query_id, predicted, votes): the commonest label among the neighbours, the smallest of equals."""
    n = neighbours.join(labels.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("_l")), "vec_id").groupBy("query_id", "_l").agg(F.count("*").alias("votes"))
    return n.groupBy("query_id").agg(F.max_by(F.struct(F.col("_l").alias("predicted"), "votes"), F.struct("votes", -F.col("_l"))).alias("b")).select("query_id", "b.*")


def recall(truth: DataFrame, found: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, recall): mean share of the true k best that are among the found k best."""
    n = truth.select("query_id").distinct().count()
    both = truth.select("query_id", "vec_id", F.col("rank").alias("tr")).join(found.select("query_id", "vec_id", F.col("rank").alias("fr")), ["query_id", "vec_id"])
    # Counted by the rank from which on a hit counts, so that one row for each rank meets the ks.
    hits = both.groupBy(F.greatest("tr", "fr").alias("r")).agg(F.count("*").alias("n"))
    k = truth.sparkSession.createDataFrame([(x,) for x in ks], "k long")
    return k.join(hits, F.col("r") <= F.col("k"), "left").groupBy("k").agg(F.round(F.coalesce(F.sum("n"), F.lit(0)) / (F.col("k") * F.lit(max(n, 1))), 6).alias("recall"))


def gsq_scan(df: DataFrame, decoded: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """k best by inner product of exact queries with decoded rows, divided by the rows' norms."""
    return knn(df, decoded.select(id_col, F.col("decoded").alias(vec_col)), k, "cosine", id_col, vec_col)
