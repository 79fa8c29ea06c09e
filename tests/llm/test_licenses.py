from __future__ import annotations

import random

import pyarrow as pa

from glossa.llm import licenses as li
from tests.llm.helpers import SCHEMA, odd_rows, prose, row, rows_of, table


def naive_statistics(sequences, tokens):
    """For each position the longest run that ends there and occurs in a sequence."""
    runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    out = []
    for i in range(1, len(tokens) + 1):
        out.append(max((k for k in range(1, i + 1) if tuple(tokens[i - k : i]) in runs), default=0))
    return out


def test_matching_statistics_and_places():
    r = random.Random(1)
    for _ in range(60):
        sequences = [[r.randint(0, 3) for _ in range(r.randint(1, 12))] for _ in range(4)]
        a = li.Automaton(sequences)
        tokens = [r.randint(-1, 4) for _ in range(40)]
        got = a.statistics(tokens)
        assert [n for n, _ in got] == naive_statistics(sequences, tokens)
        for i, (n, v) in enumerate(got):
            if n:
                run = tokens[i + 1 - n : i + 1]
                places = {(s, e) for s, seq in enumerate(sequences) for e in range(n, len(seq) + 1) if seq[e - n : e] == run}
                assert set(a.ends[v]) == places


def brute_spans(text_tokens, template, p):
    """The largest share of a template that runs of tokens, in order in both, cover within a stretch (quadratic)."""
    n, m = len(text_tokens), len(template)
    best = 0
    run = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            if text_tokens[i] == template[j]:
                run[i + 1][j + 1] = run[i][j] + 1
                best = max(best, run[i + 1][j + 1])
    return best / m


def test_every_template_is_found_whole():
    scanner = li.Scanner(li.TEMPLATES, li.LicenseParams())
    for name, texts in li.TEMPLATES.items():
        for t in texts:
            found = scanner.scan(pa.array([prose(1, 30) + "\n" + t.upper() + "\n" + prose(2, 30)], pa.large_string()))
            assert name in found[1], t


def test_longest_exact_run_against_brute_force():
    """A span with coverage 1 is reported exactly where the whole template occurs."""
    r = random.Random(3)
    templates = {"X": ("alpha beta gamma delta epsilon",), "Y": ("beta gamma zeta",)}
    scanner = li.Scanner(templates, li.LicenseParams(gap=0, coverage=1.0))
    words = "alpha beta gamma delta epsilon zeta other".split()
    for _ in range(200):
        t = [r.choice(words) for _ in range(30)]
        rows, names, a, b, share = scanner.scan(pa.array([" ".join(t)], pa.large_string()))
        got = {(n, x, y) for n, x, y in zip(names, a, b, strict=True)}
        for name, (seq,) in templates.items():
            seq = seq.split()
            at = [i for i in range(len(t) - len(seq) + 1) if t[i : i + len(seq)] == seq]
            if name == "X":
                assert {x for x in got if x[0] == "X"} == {("X", i, i + len(seq)) for i in at}
            else:
                assert {x for x in got if x[0] == "Y"} <= {("Y", i, i + len(seq)) for i in at}
            assert bool(at) == (brute_spans(t, seq, None) == 1)


def test_planted_kinds_headers_and_whole_files():
    scanner = li.Scanner(li.TEMPLATES, li.LicenseParams())

    def names(text):
        return scanner.scan(pa.array([prose(1, 30) + "\n" + text + "\n" + prose(2, 30)], pa.large_string()))[1]

    kinds = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    for text, name in kinds.items():
        assert names(text) == [name], text
    header = "you can redistribute it and/or modify it\n# under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    for kind, version, name in (("", 3, "GPL-3.0"), ("", 2, "GPL-2.0"), ("Lesser ", 3, "LGPL-3.0"), ("Affero ", 3, "AGPL-3.0")):
        assert names(header.format(kind, version)) == [name]
    for name in ("AGPL-3.0", "Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"):
        words = li.TEMPLATES[name][-1].split()
        assert len(words) > 1000
        assert names(" ".join(w for i, w in enumerate(words) if i % 97 != 50)) == [name]


NEAR = {
    "Licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "CC-BY-ND-4.0",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0",
    "Licensed under the GNU General Public License, version 1": "GPL-1.0",
    "Licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "Licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "Licensed under the BSD 2-Clause License": "BSD-2-Clause",
    "Licensed under the BSD 3-Clause License": "BSD-3-Clause",
    "Licensed under the Apache License, Version 1.1": "Apache-1.1",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    # Versions and kinds without a template are nothing rather than their neighbour.
    "Licensed under the Apache License, Version 7.0": None,
    "Licensed under the BSD 4-Clause License": None,
    "Licensed under the GNU General Public License, version 2.9": None,
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 International License": None,
}


def test_near_licences_are_told_apart():
    scanner = li.Scanner(li.TEMPLATES, li.LicenseParams())
    for text, name in NEAR.items():
        got = scanner.scan(pa.array([prose(1, 30) + "\n" + text + "\n" + prose(2, 30)], pa.large_string()))[1]
        assert got == ([name] if name else []), text


def test_chains_with_gaps_against_brute_force():
    """The best share over all chains of common runs of one template, with at most ``gap`` words between them on either side."""
    r = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    for _ in range(150):
        gap = r.randint(1, 3)
        p = li.LicenseParams(gap=gap, coverage=0.5, min_run=2, notice=0)
        template = r.sample(words, 7)
        text = []
        for w in template:
            if r.random() < 0.85:
                text.append(w)
            text += ["other"] * r.choice([0, 0, 0, 1, 2, 4])
        text = ["other"] * 3 + text + ["other"] * 3
        place = {w: i for i, w in enumerate(template)}
        runs = []  # maximal common runs: the template's words are distinct
        i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in place and place[text[j]] == place.get(text[i], -9) + j - i:
                j += 1
            if j - i >= 2:
                runs.append((i, j, place[text[i]]))
            i = max(j, i + 1)
        best = 0.0
        for mask in range(1, 1 << len(runs)):
            chain = [x for k, x in enumerate(runs) if mask >> k & 1]
            if all(b[0] - a[1] <= gap and b[2] - (a[2] + a[1] - a[0]) <= gap and b[2] >= a[2] + a[1] - a[0] for a, b in zip(chain[:-1], chain[1:], strict=True)):
                best = max(best, sum(x[1] - x[0] for x in chain) / max(7, chain[-1][1] - chain[0][0]))
        got = li.Scanner({"X": (" ".join(template),)}, p).scan(pa.array([" ".join(text)], pa.large_string()))
        assert max(got[4], default=0.0) <= best + 1e-6
        if best >= 0.75:
            assert got[4], (template, text)


def test_edited_and_interrupted_texts():
    scanner = li.Scanner(li.TEMPLATES, li.LicenseParams())
    mit = li.TEMPLATES["MIT"][3].split()
    edited = [w for i, w in enumerate(mit) if i % 17 != 9]
    broken = mit[:25] + ["// *", "#", "unrelated"] + mit[25:]
    for t in (edited, broken):
        _, names, a, b, share = scanner.scan(pa.array(["x y z " + " ".join(t)], pa.large_string()))
        assert "MIT" in names and share[names.index("MIT")] >= 0.8
    assert scanner.scan(pa.array(["licensed software " + " ".join(mit[:10]) + prose(5, 50)], pa.large_string()))[1] == []


def test_odd_rows(spark):
    text = "Licensed under the MIT License."
    docs = table(spark, odd_rows() + [row(50, text), row(50, text), row(None, text), row(51, prose(6, 80_000) + " " + text)], clash=True)
    got = [(r.doc_id, r.license, r.start, r.end) for r in li.license_spans(docs).collect()]
    assert sorted(got, key=repr) == sorted([(50, "MIT", 0, 5), (50, "MIT", 0, 5), (None, "MIT", 0, 5), (51, "MIT", 80_000, 80_005)], key=repr)
    assert rows_of(li.license_spans(docs, {})) == [] and rows_of(li.license_spans(docs, {"E": ("", "!!")})) == []
    assert rows_of(li.license_spans(spark.createDataFrame([], SCHEMA))) == []
