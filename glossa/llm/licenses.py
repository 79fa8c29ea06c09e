"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of every template. A file's tokens are streamed through it, which gives at each
position the longest run that ends there and occurs in a template (matching statistics). Maximal long runs are then chained, in order
in the file and in the template, into spans whose covered share of the template decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to the public domain", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.",
    "under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1}",
    "under the terms of the GNU {0}General Public License version {1} as published by the Free Software Foundation",
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
#: Standard headers, short whole texts and further notices.
_MORE: dict[str, tuple[str, ...]] = {
    "MIT": (
        TEMPLATES["MIT"][3] + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-2.0": (*(x.format("", "2") for x in _GNU), "SPDX-License-Identifier: GPL-2.0-or-later"),
    "GPL-3.0": tuple(x.format("", "3") for x in _GNU),
    "LGPL-2.1": (*(x.format("Lesser ", "2.1") for x in _GNU), "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "LGPL-3.0": (*(x.format("Lesser ", "3") for x in _GNU), "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": (*(x.format("Affero ", "3") for x in _GNU), "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "BSD-2-Clause": (_TWO + _AS_IS, "Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
        "SPDX-License-Identifier: Zlib",
    ),
    "Proprietary": ("All rights reserved.",),
}
_CC = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
for _kind in ("BY-ND", "BY-NC-ND", "BY-NC-SA"):
    _MORE[f"CC-{_kind}-4.0"] = (f"Licensed under CC {_kind} 4.0.", f"This work is licensed under a Creative Commons {'-'.join(_CC[x] for x in _kind.split('-'))} 4.0 International License")
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-ND", "BY-NC-SA"):
    _MORE[f"CC-{_kind}-4.0"] = (*_MORE.get(f"CC-{_kind}-4.0", ()), f"SPDX-License-Identifier: CC-{_kind}-4.0")
for _kind, _versions in (("", ("1", "2", "3")), ("Lesser ", ("2.1", "3")), ("Library ", ("2",)), ("Affero ", ("3",))):
    for _v in _versions:
        _short = {"": "GPL", "Lesser ": "LGPL", "Library ": "LGPL", "Affero ": "AGPL"}[_kind] + "-" + (_v if "." in _v else _v + ".0")
        _MORE[_short] = (*_MORE.get(_short, ()), f"Licensed under the GNU {_kind}General Public License, version {_v}", f"Licensed under the GNU {_kind}General Public License v{_v if '.' in _v else _v + '.0'}", f"This work is licensed under the GNU {_kind}General Public License, version {_v}.")
_MORE["Apache-1.1"] = ("Licensed under the Apache License, Version 1.1", "The Apache Software License, Version 1.1", "SPDX-License-Identifier: Apache-1.1")
_MORE["BSL-1.0"] = (
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Boost Software License 1.0",
    "SPDX-License-Identifier: BSL-1.0",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
    "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
)
for _name, _texts in _MORE.items():
    TEMPLATES[_name] = TEMPLATES.get(_name, ()) + _texts
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES[_file.stem] = TEMPLATES.get(_file.stem, ()) + (_file.read_text(encoding="utf-8"),)


@dataclass(frozen=True)
class LicenseParams:
    #: Least tokens of a run that takes part in a chain; a template shorter than that must match whole.
    min_run: int = 3
    #: Most file tokens, and most template tokens, between two runs of a chain.
    gap: int = 8
    #: Least share of a template's tokens that a chain covers; tokens by which the span is longer than the template count as not covered.
    coverage: float = 0.8
    #: In templates of up to so many tokens no name or version may be missing, and in their spans none may be added.
    notice: int = 80


#: Names and versions: words by which licences of one family differ. Numbers are such words too.
NAMES = frozenset(
    "affero lesser library gpl lgpl agpl mit apache bsd isc mpl mozilla boost bsl zlib epl eclipse cc0 unlicense cc by nc nd sa attribution noncommercial noderivatives noderivs sharealike".split()
)


def distinguishing(word: str) -> bool:
    w = word.lower()
    return w in NAMES or w.isdigit() or (w[:1] == "v" and w[1:].isdigit())


class Automaton:
    """Generalised suffix automaton of several token sequences, with the places where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for s, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, ends)
                ends[last].append((s, i + 1))
        # A state's runs also end wherever those of the states that link to it do.
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                ends[self.link[v]] += ends[v]
        self.ends = [sorted(set(x)) for x in ends]

    def _state(self, length: int, edges: dict[int, int], link: int, ends: list) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.link) - 1

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, c, q, ends)
        cur = self._state(self.length[last] + 1, {}, 0, ends)
        v = last
        while v != -1 and c not in self.next[v]:
            self.next[v][c] = cur
            v = self.link[v]
        if v != -1:
            q = self.next[v][c]
            self.link[cur] = q if self.length[q] == self.length[v] + 1 else self._clone(v, c, q, ends)
        return cur

    def _clone(self, v: int, c: int, q: int, ends: list) -> int:
        copy = self._state(self.length[v] + 1, dict(self.next[q]), self.link[q], ends)
        while v != -1 and self.next[v].get(c) == q:
            self.next[v][c] = copy
            v = self.link[v]
        self.link[q] = copy
        return copy

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest run that ends at each token."""
        out, v, n = [], 0, 0
        for c in tokens:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                n += 1
            else:
                v, n = 0, 0
            out.append((n, v))
        return out


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], p: LicenseParams):
        self.p = p
        pairs = [(name, text) for name in sorted(templates) for text in templates[name]]
        sequences = [[int(h) for h in tv.tokenize(pa.array([text], pa.large_string())).hashes] for _, text in pairs]
        full = [(n, s) for (n, _), s in zip(pairs, sequences, strict=True) if s]
        self.names, sequences = [n for n, _ in full], [s for _, s in full]
        marked = [w for w in sorted(NAMES | {x.lower() for _, text in pairs for x in re.findall(r"\w+", text)} | {f"{v}{i}" for v in ("", "v") for i in range(10)}) if distinguishing(w)]
        marks = np.array([tv.hash_word(w) for w in marked], np.uint64)
        self.vocabulary = np.unique(np.concatenate((np.array([w for s in sequences for w in s], np.uint64), marks if sequences else marks[:0])))
        #: Numbers of the words that tell licences apart, and for each notice where it has them.
        self.digits = set(np.flatnonzero(np.isin(self.vocabulary, np.array([tv.hash_word(w) for w in marked if w[-1].isdigit()], np.uint64))).tolist())
        self.marks = set(np.flatnonzero(np.isin(self.vocabulary, marks)).tolist())
        number = {int(h): i for i, h in enumerate(self.vocabulary)}
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton([[number[w] for w in s] for s in sequences])
        self.named = [{i for i, w in enumerate(s) if number[w] in self.marks} if len(s) <= p.notice else None for s in sequences]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.vocabulary >> np.uint64(48)] = True
        self.least = min([min(p.min_run, n) for n in self.sizes], default=1)

    def chains(self, tokens: list[int]) -> list[tuple[str, int, int, float]]:
        """(licence, first token, end, coverage) in a stretch of template tokens; -1 stands for any other token."""
        stats = self.automaton.statistics(tokens)
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, (n, v) in enumerate(stats):
            if n < self.least or (i + 1 < len(stats) and stats[i + 1][0] == n + 1):
                continue  # not maximal: the run goes on
            for s, e in self.automaton.ends[v]:
                if n >= min(self.p.min_run, self.sizes[s]):
                    by.setdefault(s, []).append((i + 1, e, n))
        out = []
        for s, runs in by.items():
            # best[k]: tokens covered by the best chain that ends with run k, and the chain's first token.
            runs.sort()
            best: list[tuple[int, int]] = []
            ended = [True] * len(runs)
            before = [-1] * len(runs)
            for k, (fe, te, n) in enumerate(runs):
                cover, start = n, fe - n
                for j in range(k - 1, -1, -1):
                    fj, tj, _ = runs[j]
                    if fe - n - fj > self.p.gap:
                        if fe - fj > self.p.gap + self.sizes[s]:
                            break
                        continue
                    if tj < te and fj < fe and te - n - tj <= self.p.gap:
                        gain = min(n, te - tj, fe - fj)
                        if best[j][0] + gain > cover:
                            cover, start, before[k] = best[j][0] + gain, best[j][1], j
                best.append((cover, start))
                if before[k] >= 0:
                    ended[before[k]] = False
            for k, (fe, _, _) in enumerate(runs):
                share = best[k][0] / max(self.sizes[s], fe - best[k][1])
                if ended[k] and share >= self.p.coverage and self._same_names(s, tokens, runs, before, k):
                    out.append((self.names[s], best[k][1], fe, share, best[k][0]))
        # Of overlapping spans the one that covers more template tokens stays, then the larger coverage, then the name.
        out.sort(key=lambda x: (-x[4], -x[3], x[0], x[1]))
        kept: list[tuple] = []
        for x in out:
            if all(x[2] <= y[1] or x[1] >= y[2] for y in kept):
                kept.append(x)
        return sorted((x[:4] for x in kept), key=lambda x: (x[1], x[2], x[0]))

    def _same_names(self, s: int, tokens: list[int], runs: list[tuple[int, int, int]], before: list[int], k: int) -> bool:
        """Whether a chain covers all names and versions of a notice and its span has no others, nor goes on with a number after a number."""
        named = self.named[s]
        if named is None:
            return True
        end, missing, added = runs[k][0], set(named), set()
        while k >= 0:
            fe, te, n = runs[k]
            missing.difference_update(range(te - n, te))
            if before[k] >= 0:
                added.update(tokens[runs[before[k]][0] : fe - n])
            k = before[k]
        if missing or added & self.marks:
            return False
        after = tokens[end] if end < len(tokens) else -1
        return not (after in self.digits and tokens[end - 1] in self.digits)

    def scan(self, column: pa.Array) -> tuple[list[int], list[str], list[int], list[int], list[float]]:
        rows, names, starts, ends, shares = [], [], [], [], []
        for i, j in tv.chunks(column):
            t = tv.tokenize(column.slice(i, j - i))
            if not len(t.hashes) or not len(self.vocabulary):
                continue
            at = np.flatnonzero(self.maybe[t.hashes >> np.uint64(48)])
            slot = np.minimum(np.searchsorted(self.vocabulary, t.hashes[at]), len(self.vocabulary) - 1)
            hit = self.vocabulary[slot] == t.hashes[at]
            at, slot = at[hit], slot[hit]
            if not len(at):
                continue
            # Stretches of template tokens of one text with gaps that a chain may cross; only those with a run as long as the least can match.
            text = np.searchsorted(t.offsets, at, side="right") - 1
            fresh = np.concatenate(([True], (np.diff(at) > self.p.gap + 1) | (np.diff(text) != 0)))
            run = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(text) != 0)))
            first = np.flatnonzero(run)
            long = np.repeat(np.diff(np.append(first, len(at))) >= self.least, np.diff(np.append(first, len(at))))
            cut = np.append(np.flatnonzero(fresh), len(at))
            useful = np.add.reduceat(long, cut[:-1]) > 0
            for a, b in zip(cut[:-1][useful].tolist(), cut[1:][useful].tolist(), strict=True):
                base = int(at[a])
                tokens = [-1] * (int(at[b - 1]) - base + 1)
                for q, w in zip((at[a:b] - base).tolist(), slot[a:b].tolist(), strict=True):
                    tokens[q] = w
                for name, s, e, share in self.chains(tokens):
                    rows.append(i + int(text[a]))
                    names.append(name)
                    starts.append(base + s - int(t.offsets[text[a]]))
                    ends.append(base + e - int(t.offsets[text[a]]))
                    shares.append(round(share, 6))
        return rows, names, starts, ends, shares


def license_spans(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, p: LicenseParams = LicenseParams()) -> DataFrame:
    """(doc_id, license, start, end, coverage): spans of words (0-based, end exclusive) that cover a template of a licence.

    Words are compared in lower case and without punctuation. Spans of one document don't overlap: the one that covers more template
    words stays, of equal ones the larger coverage, then the first name. One narrow pass over whole texts of any length. Null or empty texts
    have no spans, repeated rows repeat, a null doc_id is kept, other columns are not read; without templates, or for an empty table,
    the result is empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, p))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names, starts, ends, shares = shared.value.scan(tv.strings(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "license", "start", "end", "coverage"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, license string, start long, `end` long, coverage double")
