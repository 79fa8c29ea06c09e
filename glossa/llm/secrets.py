"""Secret scan: a character convolutional network in numpy over every candidate string and its surroundings.

A candidate is a run of at least ``min_run`` key characters with a digit, or of at least ``min_assigned`` of them after ``=`` or ``:``.
So is every value of at least ``min_assigned`` bytes after ``=`` or ``:`` that holds other characters: all that stands between quotes, or
up to white space. Findings that overlap are one. Shorter runs, and unassigned ones without a digit, are no candidates.
The network embeds characters, convolves them, takes the maxima of three regions (before, candidate, after) and
a hidden layer. It is trained on labelled findings, calibrated (Platt) on one part of them, and its threshold is the largest that
keeps the required recall on another.
"""

from __future__ import annotations

import base64
import hashlib
import random
import string
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import lean


@dataclass(frozen=True)
class SecretParams:
    min_run: int = 16
    min_assigned: int = 8
    before: int = 32
    head: int = 32
    tail: int = 16
    after: int = 12
    embed: int = 8
    width: int = 5
    filters: int = 24
    hidden: int = 16
    findings: int = 6000
    epochs: int = 12
    rate: float = 0.01
    recall: float = 0.995
    seed: int = 11


_RUN = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-+/=.~":
    _RUN[_c] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SKIP = np.zeros(256, bool)
for _c in b" \t\"'`":
    _SKIP[_c] = True
#: One symbol for each printable ASCII character, line break, other control characters and bytes above; 0 is padding.
_SYMBOL = np.full(256, 97, np.uint8)
_SYMBOL[32:127] = np.arange(1, 96)
_SYMBOL[10] = _SYMBOL[13] = 96
SYMBOLS = 98


def candidates(data: np.ndarray, offsets: np.ndarray, p: SecretParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and end of every candidate in the texts that offsets cut data into."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, none, none
    run = _RUN[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, run[:-1]
    after[-1], after[:-1] = False, run[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    before[first[first < n]] = False
    after[last[last >= 0]] = False
    s, e = np.flatnonzero(run & ~before), np.flatnonzero(run & ~after) + 1
    long = e - s >= p.min_assigned
    s, e = s[long], e[long]
    text = np.searchsorted(offsets, s, side="right") - 1
    floor = offsets[text]
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    keep = (e - s >= p.min_run) & (digits[e] > digits[s])
    # An assignment: up to four quotes and blanks, then = or :. A run may itself hold the sign (KEY=value).
    at, open_ = s - 1, np.ones(len(s), bool)
    for _ in range(4):
        skip = open_ & (at >= floor) & _SKIP[data[np.maximum(at, 0)]]
        at = at - skip
        open_ = skip
    sign = data[np.maximum(at, 0)]
    keep |= (at >= floor) & ((sign == 61) | (sign == 58))
    equals = np.concatenate(([0], np.cumsum(data == 61)))
    keep |= (e - s >= p.min_assigned + 4) & (equals[np.maximum(e - 2, s)] > equals[s])
    return text[keep], s[keep], e[keep]


_BLANK = np.zeros(256, bool)
_BLANK[:33] = _BLANK[127] = True
_CLOSE = np.zeros(256, bool)
for _c in b"\"'`,;)]}>":
    _CLOSE[_c] = True


def assigned(data: np.ndarray, offsets: np.ndarray, p: SecretParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and end of the values after = or : that hold other characters than those of a run.

    A value in quotes goes to the same quote in its line; one without, or whose quote isn't closed, to white space, without closing
    marks at its end.
    """
    sign = np.flatnonzero((data == 61) | (data == 58))
    if not len(sign):
        return sign, sign, sign
    text = np.searchsorted(offsets, sign, side="right") - 1
    end = offsets[text + 1]
    last = len(data) - 1
    at, quote, open_ = sign + 1, np.zeros(len(sign), np.uint8), np.ones(len(sign), bool)
    for _ in range(4):
        c = data[np.minimum(at, last)]
        open_ &= (at < end) & _SKIP[c] & (quote == 0)
        quote = np.where(open_ & (c != 32) & (c != 9), c, quote)
        at = at + open_

    def following(marks: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        where = np.append(np.flatnonzero(marks), len(data))
        return np.minimum(where[np.searchsorted(where, at)], end)

    stop = following(_BLANK[data], at, end)
    line = following((data == 10) | (data == 13), at, end)
    escaped = np.concatenate(([False], data[:-1] == 92))
    closed = np.zeros(len(sign), bool)
    for q in b"\"'`":
        k = np.flatnonzero(quote == q)
        if len(k):
            to = following((data == q) & ~escaped, at[k], end[k])
            closed[k] = to < line[k]
            stop[k] = np.where(closed[k], to, stop[k])
    while (trim := ~closed & (stop > at) & _CLOSE[data[np.maximum(stop - 1, 0)]]).any():
        stop = stop - trim
    others = np.concatenate(([0], np.cumsum(~_RUN[data])))
    keep = (stop - at >= p.min_assigned) & (others[np.maximum(stop, at)] > others[np.minimum(at, len(data))])
    return text[keep], at[keep], stop[keep]


def windows(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, s: np.ndarray, e: np.ndarray, p: SecretParams) -> np.ndarray:
    """(candidates x length) symbols: before | first and last characters of the candidate | after, padded with 0."""
    size = p.before + p.head + p.tail + p.after
    k = np.arange(size)
    pos = np.where(k < p.before, s[:, None] - p.before + k, 0)
    head = k - p.before
    n = (e - s)[:, None]
    pos = np.where((head >= 0) & (head < p.head), np.where(head < n, s[:, None] + head, -1), pos)
    t = head - p.head
    rest = np.minimum(p.tail, np.maximum(0, n - p.head))
    pos = np.where((t >= 0) & (t < p.tail), np.where(t < rest, e[:, None] - rest + t, -1), pos)
    pos = np.where(t >= p.tail, e[:, None] + t - p.tail, pos)
    ok = (pos >= offsets[text][:, None]) & (pos < offsets[text + 1][:, None])
    return np.where(ok, _SYMBOL[data[np.clip(pos, 0, max(0, len(data) - 1))]], 0) if len(data) else np.zeros((0, size), np.uint8)


class Network:
    """Embedding, one convolution, regional maxima, a hidden layer and a logistic output."""

    def __init__(self, p: SecretParams):
        g = np.random.default_rng(p.seed)
        self.p = p
        self.w = {
            "e": g.normal(0, 0.3, (SYMBOLS, p.embed)),
            "c": g.normal(0, np.sqrt(2 / (p.width * p.embed)), (p.width * p.embed, p.filters)),
            "b": np.zeros(p.filters),
            "h": g.normal(0, np.sqrt(2 / (3 * p.filters)), (3 * p.filters, p.hidden)),
            "hb": np.zeros(p.hidden),
            "o": g.normal(0, 0.3, p.hidden),
            "ob": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        cut = p.before, p.before + p.head + p.tail
        n = p.before + p.head + p.tail + p.after - p.width + 1
        mid = np.arange(n) + p.width // 2
        self.region = [np.flatnonzero(mid < cut[0]), np.flatnonzero((mid >= cut[0]) & (mid < cut[1])), np.flatnonzero(mid >= cut[1])]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        w, p = self.w, self.p
        e = w["e"][x]
        v = np.lib.stride_tricks.sliding_window_view(e, p.width, axis=1)  # n, positions, embed, width
        cols = v.transpose(0, 1, 3, 2).reshape(len(x), v.shape[1], -1)
        conv = cols @ w["c"] + w["b"]
        arg = [r[0] + conv[:, r].argmax(axis=1) for r in self.region]
        pooled = np.concatenate([np.take_along_axis(conv, a[:, None, :], 1)[:, 0] for a in arg], axis=1)
        act = np.maximum(pooled, 0)
        hid = act @ w["h"] + w["hb"]
        return cols, arg, act, hid, np.maximum(hid, 0) @ w["o"] + w["ob"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 1024])[-1] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, t: int) -> None:
        w, p = self.w, self.p
        cols, arg, act, hid, out = self.forward(x)
        d = ((1 / (1 + np.exp(-out)) - y) / len(x)).astype(np.float32)
        g = {"o": np.maximum(hid, 0).T @ d, "ob": d.sum(keepdims=True)}
        dh = d[:, None] * w["o"] * (hid > 0)
        g["h"], g["hb"] = act.T @ dh, dh.sum(0)
        dp = (dh @ w["h"].T) * (act > 0)
        g["c"], g["b"], g["e"] = np.zeros_like(w["c"]), dp.reshape(len(x), 3, -1).sum((0, 1)), np.zeros_like(w["e"])
        row = np.arange(len(x))
        for r, a in enumerate(arg):
            part = dp[:, r * p.filters : (r + 1) * p.filters]
            for f in range(p.filters):
                g["c"][:, f] += cols[row, a[:, f]].T @ part[:, f]
                back = part[:, f : f + 1] * w["c"][:, f]
                for k in range(p.width):
                    np.add.at(g["e"], x[row, a[:, f] + k], back[:, k * p.embed : (k + 1) * p.embed])
        for k, v in g.items():
            m, s = state.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
            m, s = 0.9 * m + 0.1 * v, 0.999 * s + 0.001 * v * v
            state[k] = m, s
            w[k] = (w[k] - p.rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x).astype(float) + self.shift, -35, 35)))


def labelled_findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, secret 0/1): findings of the common credential formats and of what is mistaken for them, surrounded by invented prose or code."""
    r = random.Random(seed)
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    syll = ["an", "ti", "or", "the", "ed", "ing", "re", "st", "co", "la", "é", "men", "de", "que", "ion", "ß", "ü", "er", "ado", "ha", "wh", "le"]

    def pick(a: str | Sequence[str], k: int) -> str:
        return "".join(r.choice(a) for _ in range(k))

    def prose(k: int) -> str:
        s = " ".join(pick(syll, r.randint(1, 4)) for _ in range(k))
        s = s.upper() if r.random() < 0.12 else s.capitalize() if r.random() < 0.4 else s
        return s + r.choice(["", ".", ",", "!!", "***", "\n"])

    names = ["token", "api_key", "apikey", "secret", "password", "passwd", "auth_token", "access_key", "client_secret", "private_key", "credential", "SECRET_KEY", "Authorization", "db_password", "pwd", "key", "bearer"]
    plain = ["commit", "sha1", "md5", "checksum", "id", "uuid", "version", "file", "path", "url", "hash", "etag", "digest", "build", "order", "isbn", "phone", "card", "class", "width", "name", "title", "date", "count", "page", "color", "style"]

    def key() -> str:
        return r.choice([lambda: pick(hexa, r.choice([32, 40, 64])), lambda: pick(hexa, r.choice([32, 40, 64])).upper(), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(b64, 40), lambda: base64.b64encode(r.randbytes(r.choice([24, 32, 48]))).decode(), lambda: "eyJ" + pick(alnum, 17) + "." + "eyJ" + pick(alnum, 40) + "." + pick(alnum + "-_", 43), lambda: pick(alnum, r.randint(20, 44)), lambda: "AIza" + pick(alnum + "-_", 35), lambda: "glpat-" + pick(alnum, 20)])()

    def other() -> str:
        return r.choice([lambda: str(uuid.UUID(bytes=r.randbytes(16))), lambda: pick(hexa, 40), lambda: pick(hexa, 32), lambda: pick(string.digits, r.choice([16, 16, 13, 19, 17])), lambda: "-".join(pick(string.digits, 4) for _ in range(4)), lambda: "/".join(pick(syll, 2).replace("é", "e").replace("ß", "s").replace("ü", "u") for _ in range(r.randint(2, 5))) + f"/{r.randint(1, 99)}.html", lambda: f"202{r.randint(0, 9)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T12:00:00.000000", lambda: "_".join(pick(["user", "item", "row", "max", "min", "size", "value", "data"], 1) for _ in range(4)) + str(r.randint(0, 99)), lambda: pick(["an", "ti", "or", "the", "ed", "ing"], r.randint(5, 9)) + str(r.randint(0, 9)), lambda: "v1.2.3-" + pick(string.digits, 8) + "-rc1", lambda: "=" * r.randint(16, 40) + "1", lambda: "www.example.com/item/" + pick(string.digits, 6)])()

    def signed() -> str:
        marks = "!@#$%^&*?()[]{}<>|+-_=.~:;,"
        word = "".join(r.choice([c, c, c.upper(), {"a": "@", "e": "3", "i": "1", "o": "0", "s": "$"}.get(c, c)]) for c in pick(["an", "ti", "or", "pass", "ed", "word", "tro", "dor", "blue", "cat"], r.randint(2, 4)))
        mixed = pick(alnum + marks, r.randint(8, 24))
        return r.choice([word + r.choice(marks[:10]) + pick(string.digits, r.randint(1, 4)), word + pick(string.digits, r.randint(1, 4)) + r.choice(marks[:10]), mixed]).rstrip(",;)]}>") + r.choice(["!", "7", "x", "2", "#"])

    def wordy() -> str:
        w = [pick(["an", "ti", "or", "the", "ed", "ing", "re", "st", "é"], r.randint(1, 4)) for _ in range(r.randint(2, 12))]
        return r.choice([lambda: " ".join(w) + r.choice(["", ".", "!"]), lambda: ", ".join(w), lambda: "#" + pick(hexa, 6) + ";" + w[0] + ":#" + pick(hexa, 6), lambda: f"//www.{w[0]}.example/{w[1]}?id={pick(string.digits, 4)}&page={r.randint(1, 9)}", lambda: f"12:{r.randint(10, 59)}:45,{pick(string.digits, 3)}", lambda: f"{w[0]}({w[1]})", lambda: f"{w[0]}@{w[1]}.example", lambda: f"{r.randint(1, 99)}%;{w[0]}:{r.randint(1, 99)}px"])()

    def hollow() -> str:
        return r.choice(["${DB_PASSWORD}", "<your-password>", "{{ vault_password }}", "%(password)s", "os.environ['DB_PASS']", "$(get_secret 1)", "********", "must be at least 8 characters!"] if r.random() < 0.3 else ["your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "changeme_please_1", "REPLACE_WITH_TOKEN", "0000000000000000", "1234567890123456", "<redacted_value_1>", "example_password_1", "not_a_real_secret1", "os.environ.get.TOKEN1", "None_or_default_value1"])

    out = []
    for i in range(n):
        about, then = prose(r.randint(0, 8)), prose(r.randint(0, 6))
        q = r.choice(['"', '"', "'", ""])
        sign = r.choice([" = ", "=", ": ", ":", " := "])
        if i % 2:
            name = r.choice(names)
            name = name.upper() if about.isupper() or r.random() < 0.15 else name
            roll = r.random()
            cand = key() if roll < 0.7 else signed() if roll < 0.85 else pick(alnum + "_-", r.randint(10, 18))
            front = f"{about} {name}{sign}{q}" if roll < 0.95 else f"{about} Bearer "
            if roll < 0.2 and any(cand.startswith(x) for x in ("AKIA", "ghp_", "xoxb", "sk_l", "eyJ", "AIza", "glpat")):
                front, q = about + " ", ""
            out.append((front, cand, f"{q} {then}", 1))
        else:
            roll = r.random()
            if roll < 0.5:
                out.append((about + " ", other(), f" {then}", 0))
            elif roll < 0.56:
                w = [pick(["an", "ti", "or", "the", "ed", "ing", "re", "st"], r.randint(1, 4)) for _ in range(4)]
                out.append((f"{about} {r.choice(['http', 'https'])}:", r.choice([f"//www.{w[0]}.example/{w[1]}", f"//{w[0]}.example/{w[1]}/{w[2]}"]) + "?" + "&".join(f"{x}={r.choice([str(r.randint(0, 999)), w[3]])}" for x in [*w[:2], "a", "b", "id"][: r.randint(1, 5)]), f" {then}", 0))
            elif roll < 0.85:
                out.append((f"{about} {r.choice(plain)}{sign}{q}", other() if (kind := r.random()) < 0.6 else wordy() if kind < 0.85 else pick(syll, 5), f"{q} {then}", 0))
            else:
                out.append((f"{about} {r.choice(names)}{sign}{q}", hollow(), f"{q} {then}", 0))
    return out


def encode(rows: list[tuple[str, str, str, int]], p: SecretParams) -> np.ndarray:
    parts = [tuple(x.encode() for x in r[:3]) for r in rows]
    data = np.frombuffer(b"".join(b"".join(x) for x in parts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([sum(map(len, x)) for x in parts])))
    s = offsets[:-1] + np.array([len(x[0]) for x in parts])
    e = s + np.array([len(x[1]) for x in parts])
    return windows(data, offsets, np.arange(len(parts)), s, e, p)


def labelled_rows(docs: DataFrame, labelled: DataFrame, p: SecretParams = SecretParams()) -> tuple[tuple[str, str, str, int], ...]:
    """At most ``p.findings`` findings with their surroundings from labelled (doc_id, start, end, secret 0/1; characters), those with the smallest hash.

    Rows with a null in any of these or with an empty span don't count; where rows share a doc_id each is a finding; very long texts
    give only the surroundings that the network sees.
    """
    at = labelled.select(F.col("doc_id").alias("_id"), F.col("start").cast("int").alias("a"), F.col("end").cast("int").alias("z"), F.col("secret").cast("int").alias("y")).where("_id is not null and y is not null and a >= 0 and z > a")
    at = at.distinct().orderBy(F.xxhash64("_id", "a", "z"), "_id", "a", "z", "y").limit(p.findings)
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    first = F.greatest(F.col("a") - p.before, F.lit(0))
    cut = d.join(F.broadcast(at), "_id").select(F.col("text").substr(first + 1, F.col("a") - first).alias("b"), F.col("text").substr(F.col("a") + 1, F.col("z") - F.col("a")).alias("c"), F.col("text").substr(F.col("z") + 1, F.lit(p.after)).alias("d"), "y")
    return tuple(sorted((r["b"], r["c"], r["d"], r["y"]) for r in cut.where("c != ''").distinct().collect()))


@lru_cache(maxsize=4)
def train(p: SecretParams = SecretParams(), labelled: tuple[tuple[str, str, str, int], ...] = ()) -> Network:
    """Fit on 4 of 6 parts of the findings, calibrate on the fifth and set the threshold on the sixth: labelled ones and as many generated ones as are wanted besides."""
    rows = [*labelled, *labelled_findings(max(p.findings // 4, p.findings - len(labelled)), p.seed)]
    x, y = encode(rows, p), np.array([r[3] for r in rows], np.float32)
    g = np.random.default_rng(p.seed)
    order = g.permutation(len(rows))
    a, b = len(rows) * 4 // 6, len(rows) * 5 // 6
    net, state, t = Network(p), {}, 0
    for _ in range(p.epochs):
        mix = g.permutation(order[:a])
        for i in range(0, a, 64):
            t += 1
            net.step(x[mix[i : i + 64]], y[mix[i : i + 64]], state, t)
    z, yc = net.logits(x[order[a:b]]).astype(float), y[order[a:b]]
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton on the two parameters, with a small ridge
        q = 1 / (1 + np.exp(-np.clip(scale * z + shift, -35, 35)))
        d, h = q - yc, q * (1 - q)
        grad = np.array([d @ z + 1e-2 * (scale - 1), d.sum() + 1e-2 * shift])
        hess = np.array([[h @ (z * z) + 1e-2, h @ z], [h @ z, h.sum() + 1e-2]])
        move = np.linalg.solve(hess, grad)
        scale, shift = scale - move[0], shift - move[1]
        if np.abs(move).max() < 1e-9:
            break
    net.scale, net.shift = float(scale), float(shift)
    pos = np.sort(net.probability(x[order[b:]])[y[order[b:]] == 1])
    net.threshold = float(min(0.5, pos[int((1 - p.recall) * len(pos))]))
    return net


def _code_points(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in characters of byte positions."""
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return heads[at] - heads[offsets[text]]


def likelihood(net: Network, data: np.ndarray, offsets: np.ndarray, text: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The probability of every candidate, of which the network sees all characters: one longer than its window is judged by the
    window of its ends and by windows slid over the whole of it, of which the largest probability counts."""
    p = net.p
    size = p.head + p.tail
    more = np.maximum(0, -(-(e - s - size) // p.head) + 1) * (e - s > size)
    k = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    first = np.minimum(np.repeat(s, more) + k * p.head, np.repeat(e, more) - size)
    of = np.repeat(np.arange(len(s)), more)
    prob = net.probability(windows(data, offsets, np.concatenate((text, text[of])), np.concatenate((s, first)), np.concatenate((e, first + size)), p))
    best = prob[: len(s)].copy()
    np.maximum.at(best, of, prob[len(s) :])
    return best


def scan(column: pa.Array, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Text, first character, end, probability and bytes of the findings in a large_string array."""
    found: list[tuple] = []
    values: list[bytes] = []
    for a, b in tv.chunks(column):
        data, offsets = tv.buffers(column.slice(a, b - a))
        text, s, e = (np.concatenate(x) for x in zip(candidates(data, offsets, net.p), assigned(data, offsets, net.p), strict=True))
        prob = likelihood(net, data, offsets, text, s, e)
        hit = np.flatnonzero(prob >= net.threshold)
        if len(hit):
            hit = hit[np.lexsort((e[hit], s[hit]))]
            text, s, e, prob = text[hit], s[hit], e[hit], prob[hit]
            first = np.flatnonzero(np.concatenate(([True], s[1:] >= np.maximum.accumulate(e)[:-1])))
            text, s, e, prob = text[first], s[first], np.maximum.reduceat(e, first), np.maximum.reduceat(prob, first)
            hit = np.arange(len(first))
            found.append((a + text[hit], _code_points(data, offsets, text[hit], s[hit]), _code_points(data, offsets, text[hit], e[hit]), prob[hit]))
            values += [data[s[i] : e[i]].tobytes() for i in hit]
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0), []
    return *(np.concatenate(x) for x in zip(*found, strict=True)), values


def secret_findings(docs: DataFrame, p: SecretParams = SecretParams(), labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, probability, digest): every candidate that the network takes for a secret, in characters of the text.

    The value itself isn't returned, only its SHA-256. One narrow pass. The network is trained on labelled (see ``labelled_rows``), if given,
    and generated findings. A null or empty text has no findings; a text of any length is scanned whole, as is a candidate;
    findings that overlap are one, from the first's start to the last's end; repeated rows give repeated findings; an empty
    table gives an empty result; other columns are not read.
    """
    net = train(p, labelled_rows(docs, labelled, p) if labelled is not None else ())
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, s, e, prob, values = scan(tv.strings(b.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(text)), pa.array(s.astype(np.int64)), pa.array(e.astype(np.int64)), pa.array(np.round(prob, 6)), pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())], ["doc_id", "start", "end", "probability", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, start long, end long, probability double, digest string")


MASK = "[SECRET]"


def redacted(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """docs with every finding in text replaced by [SECRET], and n_chars (if there) the new length; all rows stay, as do all other columns.

    Null and empty texts stay as they are; rows are judged one by one, so repeated rows stay equal; ids may be null; an empty table gives an
    empty one. docs without a column text is an error, since nothing would be masked.
    """
    net = train(p)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    lower = [n.lower() for n in names]
    if "text" not in lower:
        raise ValueError("docs has no column text")
    at, size = lower.index("text"), lower.index("n_chars") if "n_chars" in lower else None
    schema = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            text, s, e, _, _ = scan(tv.strings(column), shared.value)
            if len(text):
                new = {}
                for i, f, g in zip(text[::-1].tolist(), s[::-1].tolist(), e[::-1].tolist(), strict=True):
                    t = new.get(i) or column[i].as_py()
                    new[i] = t[:f] + MASK + t[g:]
                rows = sorted(new)
                mask = np.zeros(b.num_rows, bool)
                mask[rows] = True
                arrays = list(b.columns)
                fresh = pa.array([new[i] for i in rows], column.type)
                arrays[at] = pc.replace_with_mask(column, pa.array(mask), fresh)
                if size is not None:
                    arrays[size] = pc.replace_with_mask(arrays[size], pa.array(mask), pc.utf8_length(fresh).cast(arrays[size].type))
                b = pa.RecordBatch.from_arrays(arrays, b.schema.names)
            yield b

    return plain.mapInArrow(lean(run), schema).toDF(*names)
