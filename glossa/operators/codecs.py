"""Vector codecs: encode to small integers and decode, with the statistics that a codec needs gathered in a first pass.

Every codec is an ``encode(matrix) -> Coded`` in numpy over Arrow batches. Global values (largest minimum, largest range, column
means, codebooks) are a fixed number of values, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.arrow import blobs, lists, map_vectors, matrix

CLIP = 0.998
FLOOR = 1e-8


# --- block codecs over columns -----------------------------------------------------------------------------------------


def percentiles(v: np.ndarray, which: list[float]) -> np.ndarray:
    """Those of the last axis (kept as 1) without its NaNs, as nanpercentile gives them, but without its loop over rows."""
    out = np.full((len(which), *v.shape[:-1], 1), np.nan)
    there = (~np.isnan(v)).sum(axis=-1)
    for n in np.unique(there[there > 0]):
        at = there == n
        out[:, at] = np.percentile(np.sort(v[at], axis=-1)[:, :n], which, axis=-1, keepdims=True)  # NaNs are sorted last
    return out


def block_statistics(x: np.ndarray, block: int, clip: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clipped values padded with NaN to whole blocks (rows x blocks x block), minima and ranges; padding takes no part."""
    n, d = x.shape
    count = -(-d // block)
    v = np.full((n, count * block), np.nan)
    v[:, :d] = x
    v = v.reshape(n, count, block)
    if clip < 1:
        v = np.clip(v, *percentiles(v, [100 * (1 - clip), 100 * clip]))
    low = np.nanmin(v, axis=2)
    return v, low, np.maximum(np.nanmax(v, axis=2) - low, FLOOR)


def encode_blocks(x: np.ndarray, block: int, levels: int, clip: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x dimensions), minima and ranges of blocks of columns."""
    v, low, span = block_statistics(x, block, clip)
    codes = np.rint((v - low[:, :, None]) / span[:, :, None] * levels)
    return codes.reshape(len(x), -1)[:, : x.shape[1]].astype(np.int32), low, span


def fixed_point(x: np.ndarray, bits: int) -> np.ndarray:
    """Signed fractions of so many bits after the point, clipped to [-1, 1 - 2**-bits]."""
    return np.rint(np.clip(x, -1, 1 - 2.0**-bits) * 2**bits)


def quantised_meta(x: np.ndarray, top: float) -> np.ndarray:
    """Block statistics as they are stored: fractions of the global maximum with 15 bits."""
    return fixed_point(x / top, 15) / 32768 * top


@dataclass(frozen=True)
class BlockModel:
    block: int
    levels: int
    clip: float
    top_min: float
    top_span: float
    mean: np.ndarray | None


def _largest(df: DataFrame, id_col: str, vec_col: str, block: int, clip: float, mean: np.ndarray | None) -> tuple[float, float]:
    def stats(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        _, low, span = block_statistics(x if mean is None else x - mean, block, clip)
        return pa.RecordBatch.from_pydict({"a": [float(np.abs(low).max())], "b": [float(span.max())]})

    r = map_vectors(df, id_col, vec_col, stats, "a double, b double").agg(F.max("a"), F.max("b")).first()
    return max(r[0] or 0.0, FLOOR), max(r[1] or 0.0, FLOOR)


def column_mean(df: DataFrame, id_col: str, vec_col: str) -> np.ndarray:
    def sums(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(x.sum(0)), pa.array(np.full(x.shape[1], len(x)))], ["dim", "s", "n"])

    rows = map_vectors(df, id_col, vec_col, sums, "dim int, s double, n long").groupBy("dim").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
    return np.array([r["m"] for r in sorted(rows, key=lambda r: r["dim"])])


def fit_blocks(df: DataFrame, id_col: str, vec_col: str, levels: int, block: int, clip: float = CLIP, centred: bool = False) -> BlockModel:
    mean = column_mean(df, id_col, vec_col) if centred else None
    return BlockModel(block, levels, clip, *_largest(df, id_col, vec_col, block, clip, mean), mean)


def stored_meta(low: np.ndarray, span: np.ndarray, m: BlockModel) -> np.ndarray:
    """Minima and ranges of each row's blocks as 16-bit fractions of the largest of all rows."""
    return np.concatenate((fixed_point(low / m.top_min, 15), fixed_point(span / m.top_span, 15)), axis=1).astype("<i2")


def decode_blocks(codes: np.ndarray, meta: np.ndarray, m: BlockModel) -> np.ndarray:
    n, d = codes.shape
    low, span = np.split(meta.astype(float) / 32768, 2, axis=1)
    low, span = (np.repeat(x * top, m.block, axis=1)[:, :d] for x, top in ((low, m.top_min), (span, m.top_span)))
    out = codes / m.levels * span + low
    return out if m.mean is None else out + m.mean


def to_bytes(x: np.ndarray, m: BlockModel) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and block statistics of each row: all that is stored of it."""
    codes, low, span = encode_blocks(x if m.mean is None else x - m.mean, m.block, m.levels, m.clip)
    return packed_codes(codes, m.levels), stored_meta(low, span, m).view(np.uint8)


def from_bytes(data: np.ndarray, meta: np.ndarray, d: int, m: BlockModel) -> np.ndarray:
    return decode_blocks(unpacked_codes(data, m.levels, d), np.ascontiguousarray(meta).view("<i2"), m)


def apply_blocks(df: DataFrame, id_col: str, vec_col: str, m: BlockModel) -> DataFrame:
    """(id, data, meta, decoded array<double>, rmse): the packed codes, the blocks' minima and ranges, and what decoding these two alone gives."""

    def run(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        data, meta = to_bytes(x, m)
        back = from_bytes(data, meta, x.shape[1], m)
        return pa.RecordBatch.from_arrays([pa.array(ids), blobs(data), blobs(meta), lists(back, pa.float64()), pa.array(np.sqrt(((back - x) ** 2).mean(1)))], [id_col, "data", "meta", "decoded", "rmse"])

    return map_vectors(df, id_col, vec_col, run, f"`{id_col}` long, data binary, meta binary, decoded array<double>, rmse double")


# --- block codecs over rows --------------------------------------------------------------------------------------------


def row_blocks(df: DataFrame, id_col: str, vec_col: str, levels: int, block: int, fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """fn(ids, codes, minima, ranges) for every block of rows (ids of one ``id div block``). A block with fewer rows is padded with zeros,
    which take part in its minima and ranges. One shuffle by block."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column(0).to_numpy()
        order = np.argsort(ids, kind="stable")
        x = matrix(t.column(1))[order]
        low, high = x.min(0), x.max(0)
        if len(x) < block:
            low, high = np.minimum(low, 0), np.maximum(high, 0)
        span = np.maximum(high - low, FLOOR)
        return fn(ids[order], np.rint((x - low) / span * levels).astype(np.int32), low, span)

    some = df.select(F.col(id_col), F.col(vec_col), F.floor(F.col(id_col) / block).alias("_b")).where(F.col(vec_col).isNotNull())
    return some.groupBy("_b").applyInArrow(lambda t: run(t.select([id_col, vec_col])), schema)


def gsq(df: DataFrame, id_col: str, vec_col: str, bits: int, block: int = 128) -> DataFrame:
    """(id, data, decoded): packed codes of blocks of rows, minimum and range by block and dimension, stored as fractions of their largest."""
    levels = 2**bits - 1

    def tops(ids: np.ndarray, codes: np.ndarray, low: np.ndarray, span: np.ndarray) -> pa.Table:
        return pa.table({"a": [float(np.abs(low).max())], "b": [float(span.max())]})

    r = row_blocks(df, id_col, vec_col, levels, block, tops, "a double, b double").agg(F.max("a"), F.max("b")).first()
    top = max(r[0] or 0.0, FLOOR), max(r[1] or 0.0, FLOOR)

    def coded(ids: np.ndarray, codes: np.ndarray, low: np.ndarray, span: np.ndarray) -> pa.Table:
        back = codes / levels * quantised_meta(span, top[1]) + quantised_meta(low, top[0])
        return pa.table({id_col: pa.array(ids), "data": blobs(packed_codes(codes, levels)), "decoded": lists(back, pa.float64())})

    return row_blocks(df, id_col, vec_col, levels, block, coded, f"`{id_col}` long, data binary, decoded array<double>")


# --- scalar codecs -------------------------------------------------------------------------------------------------------


def bfloat16(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of float32, cut off, not rounded; both zeros give 0."""
    u = (x.astype(np.float32).view(np.uint32) >> 16).astype(np.int32)
    return np.where(x == 0, 0, u)


def from_bfloat16(u: np.ndarray) -> np.ndarray:
    return (u.astype(np.uint32) << 16).view(np.float32).astype(float)


def float8(x: np.ndarray) -> np.ndarray:
    """Sign, 4 bits of exponent (float32's, held in 120..135, less 120) and the upper 3 bits of the fraction; only 0 gives 0."""
    u = x.astype(np.float32).view(np.uint32)
    e = np.clip((u >> 23) & 0xFF, 120, 135) - 120
    out = ((u >> 31) << 7) | (e << 3) | ((u >> 20) & 7)
    return np.where(x == 0, 0, out).astype(np.int32)


def from_float8(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.int64)
    v = (1 + (u & 7) / 8) * 2.0 ** (((u >> 3) & 15) + 120 - 127) * np.where(u & 128, -1, 1)
    return np.where(u == 0, 0, v)


NF_EDGES = np.array([-0.9816, 0.0, 0.9816])
NF_CENTROIDS = np.array([-1.5121, -0.4528, 0.4528, 1.5121])


def q2_nf(x: np.ndarray, block: int, clip: float = CLIP) -> tuple[np.ndarray, np.ndarray]:
    """Codes 0..3 by fixed edges of the normal distribution, and the blocks' standard deviations (population)."""
    v, _, _ = block_statistics(x, block, clip)
    std = np.maximum(np.nanstd(v, axis=2), FLOOR)
    codes = np.digitize(v / std[:, :, None], NF_EDGES)
    return codes.reshape(len(x), -1)[:, : x.shape[1]].astype(np.int32), std


# --- packing ---------------------------------------------------------------------------------------------------------


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes of 1 to 16 bits as bytes, high bits first; 2-bit codes lie low bits first, as the stored format has it."""
    n, d = codes.shape
    if bits == 2:
        pad = np.zeros((n, -d % 4), np.int64)
        c = np.concatenate((codes, pad), axis=1).reshape(n, -1, 4)
        return (c << np.array([0, 2, 4, 6])).sum(axis=2).astype(np.uint8)
    planes = (codes[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(planes.reshape(n, -1).astype(np.uint8), axis=1)


def unpack(data: np.ndarray, bits: int, d: int) -> np.ndarray:
    n = len(data)
    if bits == 2:
        return ((data[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(n, -1)[:, :d].astype(np.int32)
    planes = np.unpackbits(data, axis=1)[:, : d * bits].reshape(n, d, bits).astype(np.int32)
    return (planes << np.arange(bits - 1, -1, -1)).sum(axis=2).astype(np.int32)


def pack_ternary(codes: np.ndarray) -> np.ndarray:
    """Five codes of 0..2 in a byte, base 3, the first of highest weight."""
    n, d = codes.shape
    c = np.concatenate((codes, np.zeros((n, -d % 5), np.int64)), axis=1).reshape(n, -1, 5)
    return (c @ np.array([81, 27, 9, 3, 1])).astype(np.uint8)


def unpack_ternary(data: np.ndarray, d: int) -> np.ndarray:
    return ((data[:, :, None] // np.array([81, 27, 9, 3, 1])) % 3).reshape(len(data), -1)[:, :d].astype(np.int32)


def packed_codes(codes: np.ndarray, levels: int) -> np.ndarray:
    return pack_ternary(codes) if levels == 2 else pack(codes, levels.bit_length())


def unpacked_codes(data: np.ndarray, levels: int, d: int) -> np.ndarray:
    return unpack_ternary(data, d) if levels == 2 else unpack(data, levels.bit_length(), d)


# --- trained codecs ------------------------------------------------------------------------------------------------


def lloyd_max(values: np.ndarray, k: int, weights: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """Scalar codebook of k centroids, started at equal percentiles; ends when no centroid moves by more than 1e-6."""
    c = np.percentile(values, (np.arange(k) + 0.5) / k * 100)
    w = np.ones_like(values) if weights is None else weights
    for _ in range(steps):
        bins = np.digitize(values, (c[1:] + c[:-1]) / 2)
        mass = np.bincount(bins, w, k)
        new = np.where(mass > 0, np.bincount(bins, w * values, k) / np.maximum(mass, 1e-300), c)
        done = np.abs(new - c).max() < 1e-6
        c = new
        if done:
            break
    return np.sort(c)


def nearest(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.digitize(values, (centroids[1:] + centroids[:-1]) / 2)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, whose length must be a power of two."""
    n = x.shape[-1]
    if n & (n - 1) or not n:
        raise ValueError("the block must be a power of two")
    x = x.astype(float).copy()
    h = 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        a, b = y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]
        x = np.stack((a, b), axis=-2).reshape(x.shape)
        h *= 2
    return x


@lru_cache(maxsize=8)
def gaussian_codebook(k: int, samples: int = 200_000, seed: int = 42) -> np.ndarray:
    return lloyd_max(np.random.default_rng(seed).standard_normal(samples), k, steps=100)


def polar(x: np.ndarray, block: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and norms of blocks: unit vectors, Hadamard-rotated, each value to the nearest centroid of a normal codebook."""
    v = x.reshape(len(x), -1, block)
    norm = np.maximum(np.linalg.norm(v, axis=2), FLOOR)
    return nearest(hadamard(v / norm[:, :, None]), gaussian_codebook(k)), norm


def from_polar(codes: np.ndarray, norm: np.ndarray, k: int) -> np.ndarray:
    v = hadamard(gaussian_codebook(k)[codes]) / codes.shape[2] * norm[:, :, None]
    return v.reshape(len(codes), -1)


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


Vectors = tuple[DataFrame, str, str]


def totals(vectors: Vectors, fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of fn(matrix), a flat array of ``size`` numbers, over all vectors: added up in each task, then by place in one aggregation."""
    df, id_col, vec_col = vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for b in batches:
            if b.num_rows:
                acc += fn(matrix(b.column(0)))
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[at])], ["at", "v"])

    some = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(vec_col)
    got = some.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def seeds(vectors: Vectors, k: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, to start from."""
    df, id_col, vec_col = vectors
    rows = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(k).select(vec_col).toArrow()
    return matrix(rows.column(0))


def cell_sums(parts: list[np.ndarray], books: list[np.ndarray]) -> np.ndarray:
    """For every part and centroid the sum of the rows nearest to it and their number, flat."""
    out = []
    for x, c in zip(parts, books, strict=True):
        a = assign(x, c)
        s = np.zeros((len(c), x.shape[1] + 1))
        np.add.at(s, (a, slice(0, -1)), x)
        s[:, -1] = np.bincount(a, minlength=len(c))
        out.append(s.ravel())
    return np.concatenate(out)


def moved(books: list[np.ndarray], sums: np.ndarray) -> list[np.ndarray]:
    """Centroids at the means of their cells; an empty cell keeps its centroid."""
    out, at = [], 0
    for c in books:
        s = sums[at : at + c.size + len(c)].reshape(len(c), -1)
        at += s.size
        out.append(np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), c))
    return out


def kmeans(vectors: Vectors, k: int, steps: int = 20) -> np.ndarray:
    """Lloyd's algorithm over all vectors, one pass a step; ends early when nothing moves."""
    return lloyd(vectors, [seeds(vectors, k)], lambda x: [x], steps)[0]


def lloyd(vectors: Vectors, books: list[np.ndarray], split: Callable[[np.ndarray], list[np.ndarray]], steps: int) -> list[np.ndarray]:
    size = sum(c.size + len(c) for c in books)
    for _ in range(steps):
        new = moved(books, totals(vectors, lambda x, books=books: cell_sums(split(x), books), size))
        still = all(np.abs(a - b).max() < 1e-9 for a, b in zip(new, books, strict=True))
        books = new
        if still:
            break
    return books


def fit_pq(vectors: Vectors, parts: int, bits: int, steps: int = 20, mean: np.ndarray | float = 0.0, r: np.ndarray | None = None, books: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """A codebook for each part of the (rotated) dimensions, fitted on all vectors."""
    if bits > 8:
        raise ValueError("codes are bytes: at most 8 bits")

    def split(x: np.ndarray) -> list[np.ndarray]:
        return np.split(x - mean if r is None else (x - mean) @ r, parts, axis=1)

    return lloyd(vectors, split(seeds(vectors, 2**bits)) if books is None else books, split, steps)


def encode_pq(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([assign(s, c) for s, c in zip(np.split(x, len(books), axis=1), books, strict=True)])


def decode_pq(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([c[codes[:, i]] for i, c in enumerate(books)], axis=1)


def procrustes(xy: np.ndarray) -> np.ndarray:
    """The rotation R that brings x R nearest to y, given x'y."""
    u, _, v = np.linalg.svd(xy)
    return u @ v


def fit_opq(vectors: Vectors, parts: int, bits: int, rounds: int = 25, steps: int = 20) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Mean, rotation and codebooks over all vectors: in each round one pass gives both the next centroids and the Procrustes rotation."""
    mean = column_mean(*vectors)
    d = len(mean)
    r = np.eye(d)
    books = fit_pq(vectors, parts, bits, 3, mean, r)
    size = sum(c.size + len(c) for c in books)
    for _ in range(rounds):

        def both(x: np.ndarray, r: np.ndarray = r, books: list[np.ndarray] = books) -> np.ndarray:
            v = x - mean
            y = v @ r
            return np.concatenate((cell_sums(np.split(y, parts, axis=1), books), (v.T @ decode_pq(encode_pq(y, books), books)).ravel()))

        got = totals(vectors, both, size + d * d)
        books, new = moved(books, got[:size]), procrustes(got[size:].reshape(d, d))
        still = np.abs(new - r).max() < 1e-6
        r = new
        if still:
            break
    return mean, r, fit_pq(vectors, parts, bits, steps, mean, r, books)


#: The histogram of block-normalised values from which scalar codebooks are fitted.
EDGE, BINS = 12.0, 1 << 14


def histogram(u: np.ndarray) -> np.ndarray:
    """Mass and sum of values in each of BINS bins between -EDGE and EDGE, flat."""
    u = u[np.isfinite(u)]
    at = np.clip(((u + EDGE) * (BINS / (2 * EDGE))).astype(np.int64), 0, BINS - 1)
    return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, u, BINS)))


def lloyd_max_of(hist: np.ndarray, k: int, steps: int = 200) -> np.ndarray:
    """Scalar codebook of k centroids for a histogram; each bin counts as its mean."""
    mass, total = hist[:BINS], hist[BINS:]
    some = mass > 0
    values, weights = total[some] / mass[some], mass[some]
    run = np.cumsum(weights) / weights.sum()
    c = values[np.minimum(np.searchsorted(run, (np.arange(k) + 0.5) / k), len(values) - 1)]
    c = np.sort(c) + np.arange(k) * 1e-9
    for _ in range(steps):
        bins = np.digitize(values, (c[1:] + c[:-1]) / 2)
        m = np.bincount(bins, weights, k)
        new = np.where(m > 0, np.bincount(bins, weights * values, k) / np.maximum(m, 1e-300), c)
        done = np.abs(new - c).max() < 1e-6
        c = new
        if done:
            break
    return np.sort(c)


def fit_svd_lm(vectors: Vectors, k: int, block: int, steps: int = 50, clip: float = CLIP, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and scalar codebook over all vectors: Lloyd-Max on block-normalised rotated values and Procrustes rotation by turns, one pass a turn."""
    d = len(column_mean(*vectors))
    r = np.eye(d)

    def values(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, _, _ = block_statistics(x @ r, block, clip)
        std = np.maximum(np.nanstd(v, axis=2), FLOOR)
        return (v / std[:, :, None]).reshape(len(x), -1)[:, :d], std

    c = lloyd_max_of(totals(vectors, lambda x: histogram(values(x, np.eye(d))[0]), 2 * BINS), k)
    for _ in range(steps):

        def both(x: np.ndarray, r: np.ndarray = r, c: np.ndarray = c) -> np.ndarray:
            u, std = values(x, r)
            back = decode_svd_lm(nearest(u, c), std, c, np.eye(d), block)
            return np.concatenate((histogram(u), (x.T @ back).ravel()))

        got = totals(vectors, both, 2 * BINS + d * d)
        c, new = lloyd_max_of(got[: 2 * BINS], k), procrustes(got[2 * BINS :].reshape(d, d))
        still = np.abs(new - r).max() < tolerance
        r = new
        if still:
            break
    return r, lloyd_max_of(totals(vectors, lambda x: histogram(values(x, r)[0]), 2 * BINS), k)


def code_svd_lm(x: np.ndarray, r: np.ndarray, block: int, c: np.ndarray, clip: float = CLIP) -> tuple[np.ndarray, np.ndarray]:
    v, _, _ = block_statistics(x @ r, block, clip)
    std = np.maximum(np.nanstd(v, axis=2), FLOOR)
    u = (v / std[:, :, None]).reshape(len(x), -1)[:, : x.shape[1]]
    return nearest(u, c), std


def decode_svd_lm(codes: np.ndarray, std: np.ndarray, c: np.ndarray, r: np.ndarray, block: int) -> np.ndarray:
    return (c[codes] * np.repeat(std, block, axis=1)[:, : codes.shape[1]]) @ r.T


def with_decoded(df: DataFrame, id_col: str, vec_col: str, both: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """(id, data, decoded, rmse) by a function matrix -> (codes of ``bits`` bits, 0 for ternary ones, decoded)."""

    def run(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        codes, back = both(x)
        codes = codes.reshape(len(x), -1)
        data = pack_ternary(codes) if bits == 0 else np.ascontiguousarray(codes).astype(f"<u{bits // 8}").view(np.uint8) if bits in (8, 16, 32) else pack(codes & (2**bits - 1), bits)
        return pa.RecordBatch.from_arrays([pa.array(ids), blobs(data), lists(back, pa.float64()), pa.array(np.sqrt(((back - x) ** 2).mean(1)))], [id_col, "data", "decoded", "rmse"])

    return map_vectors(df, id_col, vec_col, run, f"`{id_col}` long, data binary, decoded array<double>, rmse double")


def code_bits(k: int) -> int:
    """Bits for k centroids as packed; 0 for three, which are packed by fives."""
    return 0 if k == 3 else max(1, (k - 1).bit_length())


def pq(df: DataFrame, id_col: str, vec_col: str, parts: int = 16, bits: int = 6, rotated: bool = False, rounds: int = 25) -> DataFrame:
    vectors = df, id_col, vec_col
    if rotated:
        mean, r, books = fit_opq(vectors, parts, bits, rounds)
    else:
        books = fit_pq(vectors, parts, bits)
        d = sum(c.shape[1] for c in books)
        mean, r = np.zeros(d), np.eye(d)

    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = encode_pq((v - mean) @ r, books)
        return codes, decode_pq(codes, books) @ r.T + mean

    return with_decoded(df, id_col, vec_col, both, bits)


def svd_lm(df: DataFrame, id_col: str, vec_col: str, centroids: int, block: int = 32, steps: int = 50) -> DataFrame:
    r, c = fit_svd_lm((df, id_col, vec_col), centroids, block, steps)

    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, std = code_svd_lm(v, r, block, c)
        return codes, decode_svd_lm(codes, std, c, r, block)

    return with_decoded(df, id_col, vec_col, both, code_bits(centroids))


def polar_codec(df: DataFrame, id_col: str, vec_col: str, centroids: int, block: int = 32) -> DataFrame:
    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, norm = polar(v, block, centroids)
        return codes, from_polar(codes, norm, centroids)

    return with_decoded(df, id_col, vec_col, both, code_bits(centroids))


def nf_codec(df: DataFrame, id_col: str, vec_col: str, block: int = 32) -> DataFrame:
    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, std = q2_nf(v, block)
        return codes, NF_CENTROIDS[codes] * np.repeat(std, block, axis=1)[:, : v.shape[1]]

    return with_decoded(df, id_col, vec_col, both, 2)


def scalar_codec(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    """e0m7, e0m11, e0m15, max8, max12, max16, bf16, e4m3, f16 or f32."""
    top = 1.0
    if name.startswith("max"):
        r = map_vectors(df, id_col, vec_col, lambda ids, x: pa.RecordBatch.from_pydict({"a": [float(np.abs(x).max())]}), "a double").agg(F.max("a")).first()
        top = max(r[0] or 0.0, FLOOR) / (2 ** (int(name[3:]) - 1) - 1)

    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if name.startswith("e0m"):
            bits = int(name[3:])
            c = fixed_point(v, bits)
            return c.astype(np.int64), c / 2**bits
        if name.startswith("max"):
            c = np.rint(v / top)
            return c.astype(np.int64), c * top
        if name == "bf16":
            c = bfloat16(v)
            return c, from_bfloat16(c)
        if name == "e4m3":
            c = float8(v)
            return c, from_float8(c)
        if name == "f16":
            return v.astype(np.float16).view(np.uint16).astype(np.int64), v.astype(np.float16).astype(float)
        return v.astype(np.float32).view(np.uint32).astype(np.int64), v.astype(np.float32).astype(float)

    return with_decoded(df, id_col, vec_col, both, {"e0m7": 8, "e0m11": 12, "e0m15": 16, "max8": 8, "max12": 12, "max16": 16, "bf16": 16, "e4m3": 8, "f16": 16, "f32": 32}[name])


def row_top_mix(df: DataFrame, id_col: str, vec_col: str, ratio: float = 0.2, bits: int = 4, block: int = 32) -> DataFrame:
    """A low codec for the whole row and float16 for the row's largest |x| (share ``ratio``; ties by dimension)."""
    m = fit_blocks(df, id_col, vec_col, 2**bits - 1, block)

    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, low, span = encode_blocks(v, block, m.levels, m.clip)
        back = decode_blocks(codes, stored_meta(low, span, m), m)
        k = max(1, int(v.shape[1] * ratio))
        top = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :k]
        np.put_along_axis(back, top, np.take_along_axis(v, top, 1).astype(np.float16).astype(float), 1)
        return codes, back

    return with_decoded(df, id_col, vec_col, both, bits)


def energy_mix(df: DataFrame, id_col: str, vec_col: str, ratio: float = 0.2, bits: int = 4, block: int = 32) -> DataFrame:
    """The dimensions with most energy (mean of squares) in float16, the others in a low codec."""

    def sums(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array((x * x).sum(0))], ["dim", "e"])

    e = {r["dim"]: r["e"] for r in map_vectors(df, id_col, vec_col, sums, "dim int, e double").groupBy("dim").agg(F.sum("e").alias("e")).collect()}
    order = sorted(e, key=lambda d: (-e[d], d))
    high = np.array(sorted(order[: max(1, int(len(order) * ratio))]), int)
    m = fit_blocks(df, id_col, vec_col, 2**bits - 1, block)

    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, low, span = encode_blocks(v, block, m.levels, m.clip)
        back = decode_blocks(codes, stored_meta(low, span, m), m)
        back[:, high] = v[:, high].astype(np.float16)
        return codes, back

    return with_decoded(df, id_col, vec_col, both, bits)


def packed_roundtrip(df: DataFrame, id_col: str, vec_col: str, bits: int) -> DataFrame:
    """(id, data, same): codes of so many bits (0: ternary) packed, and whether unpacking gives them back."""

    def run(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        levels = 2 if bits == 0 else 2**bits - 1
        codes = encode_blocks(x, x.shape[1], levels, 1.0)[0]
        data = pack_ternary(codes) if bits == 0 else pack(codes, bits)
        back = unpack_ternary(data, x.shape[1]) if bits == 0 else unpack(data, bits, x.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(ids), blobs(data), pa.array((back == codes).all(1))], [id_col, "data", "same"])

    return map_vectors(df, id_col, vec_col, run, f"`{id_col}` long, data binary, same boolean")
