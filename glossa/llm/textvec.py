"""Vectorised tokenisation over Arrow string buffers.

A token is hashed without leaving numpy: with an odd multiplier P, the prefix sums of ``byte * P**position`` (mod 2**64)
give every substring's polynomial hash as ``(S[end] - S[start]) * P**-start``. Lower-casing is Unicode-aware (Arrow);
letters and digits of ASCII, the underscore and every non-ASCII character belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

WORD_CLASS = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    WORD_CLASS[_c] = 1
WORD_CLASS[128:] = 1
#: As above, and 2 for printable ASCII signs, so that a run of signs is a token too.
SIGN_CLASS = WORD_CLASS.copy()
for _c in range(33, 127):
    if SIGN_CLASS[_c] == 0:
        SIGN_CLASS[_c] = 2
#: The same tokens for SQL engines with RE2 syntax.
WORD_RE2 = r"[0-9a-z_\x{80}-\x{10FFFF}]+"

CHUNK_BYTES = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0..P**n and their inverses, grown on demand and kept for the worker's life."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for key, base in (("p", _P), ("q", _P_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Tokens:
    """Tokens of several texts: ``hashes[offsets[i]:offsets[i + 1]]`` are those of text i; starts and ends are bytes in data."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    text_starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One plain string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array, without copying."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    if len(column) == 0:
        return
    _, offsets = buffers(column)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def tokenize(column: pa.Array, classes: np.ndarray = WORD_CLASS, lower: bool = True) -> Tokens:
    """Tokens of a large_string array; whole texts, any length."""
    if lower:
        column = pc.utf8_lower(column)
    data, offsets = buffers(column)
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, U64), np.zeros(len(column) + 1, np.int64), z, z, data, offsets)
    cls = classes[data]
    firsts = offsets[:-1]
    before = np.empty(n, np.uint8)
    before[0] = 0
    before[1:] = cls[:-1]
    before[firsts[firsts < n]] = 0
    after = np.empty(n, np.uint8)
    after[-1] = 0
    after[:-1] = cls[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = 0
    starts = np.flatnonzero((cls != 0) & (cls != before))
    ends = np.flatnonzero((cls != 0) & (cls != after)) + 1
    p, q = powers(n)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(data * p[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * q[starts])
    return Tokens(hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def hash_word(word: str) -> int:
    """The hash that tokenize gives to one token."""
    h = 0
    for i, b in enumerate(word.lower().encode()):
        h = (h + b * pow(_P, i, 2**64)) % 2**64
    return int(mix(np.array([h], U64))[0])


def ngrams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-token windows that lie inside one text, and the index of each one's first token."""
    m = len(t.hashes)
    if m < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    left = np.repeat(t.offsets[1:], t.counts) - np.arange(m)
    at = np.flatnonzero(left >= n)
    h = np.zeros(len(at), U64)
    for k in range(n):
        h = mix(h * U64(0x2545F4914F6CDD1D) + t.hashes[at + k])
    return h, at


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    if len(keys) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
