from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from glossa.llm import mixing as x
from glossa.llm.common import table as read
from tests.llm.helpers import SCHEMA, odd_rows, prose, row, rows_of, table


def scaled(cells: dict[tuple[str, str], float], goal_s: dict[str, float], goal_l: dict[str, float]) -> dict[tuple[str, str], float]:
    """Rates by iterative proportional fitting, which has the same optimum."""
    rate = dict.fromkeys(cells, 1.0)
    for _ in range(5000):
        for side, goal in ((0, goal_s), (1, goal_l)):
            total = defaultdict(float)
            for k, t in cells.items():
                total[k[side]] += t * rate[k]
            for k in cells:
                rate[k] *= goal[k[side]] / total[k[side]]
    return rate


def test_rates_are_the_entropy_optimum(spark):
    rows, n = [], 0
    for s, sizes in {"a": (400, 60), "b": (50, 90), "c": (10, 30)}.items():
        for lang, k in zip(("en", "fr"), sizes, strict=True):
            for _ in range(10):
                rows.append(row(n, prose(n, k), lang, s))
                n += 1
    p = x.MixingParams(targets={"a": 0.2, "b": 0.5, "c": 0.3}, budget=1.5)
    got = x.document_rates(table(spark, rows), p).collect()
    cells = defaultdict(float)
    for r in got:
        cells[r.source, r.lang] += r.tokens
    total = sum(cells.values())
    langs = defaultdict(float)
    for (_, lang), t in cells.items():
        langs[lang] += t
    want = scaled(cells, {s: v * 1.5 * total for s, v in p.targets.items()}, {k: v * 1.5 for k, v in langs.items()})
    for r in got:
        assert r.rate == pytest.approx(want[r.source, r.lang], rel=1e-6)
        assert r.copies in (math.floor(r.rate), math.ceil(r.rate))
    for s in "abc":
        assert abs(sum(r.copies - r.rate for r in got if r.source == s)) < 1


def test_constraints_on_the_documents(spark, data):
    docs = read(spark, data, "documents")
    got = x.document_rates(docs).toPandas()
    assert len(got) == docs.count()
    natural = got.groupby("source").tokens.sum() / got.tokens.sum()
    share = natural**0.5 / (natural**0.5).sum()
    mixed = (got.tokens * got.rate).groupby(got.source).sum() / got.tokens.sum()
    assert np.allclose(mixed, share, rtol=1e-4)
    by_lang = (got.tokens * got.rate).groupby(got.lang).sum() / got.groupby("lang").tokens.sum()
    assert np.allclose(by_lang, 1, rtol=1e-4)


def test_buckets_don_t_change_copies_sums(spark):
    docs = table(spark, [row(i, prose(i, 20 + i % 7), "en", "a" if i % 3 else "b") for i in range(400)])
    for per in (3, 50_000):
        got = x.document_rates(docs, x.MixingParams(targets={"a": 1.0, "b": 2.0}, rows_per_bucket=per)).collect()
        for s in "ab":
            assert abs(sum(r.copies - r.rate for r in got if r.source == s)) < 1


def test_mixed_repeats_documents(spark):
    docs = table(spark, [row(i, prose(i, 30), "en", "a" if i < 30 else "b") for i in range(40)], clash=True)
    p = x.MixingParams(targets={"a": 0.25, "b": 0.75})
    rates = {r.doc_id: r for r in x.document_rates(docs, p).collect()}
    out = x.mixed(docs, p)
    assert set(out.columns) == set(docs.columns) | {"rate", "copy"}
    seen = defaultdict(list)
    for r in out.collect():
        seen[r.doc_id].append(r["copy"])
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(1, r.copies + 1)) for k, r in rates.items() if r.copies}


def test_odd_rows(spark):
    docs = table(spark, odd_rows(), clash=True)
    got = x.document_rates(docs).collect()
    assert len(got) == docs.count()
    assert all(r.rate is not None and r.copies >= 0 for r in got)
    assert {r.tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert x.mixed(docs).count() > 0
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of(x.document_rates(none)) == [] and rows_of(x.mixed(none)) == []
    only = x.document_rates(table(spark, [row(1, "a b c"), row(2, None)]), x.MixingParams(targets={"a": 1.0})).collect()
    assert [(r.doc_id, r.rate, r.copies) for r in sorted(only)] == [(1, 1.0, 1), (2, 1.0, 1)]
    with pytest.raises(ValueError):
        x.document_rates(docs, x.MixingParams(targets={"nowhere": 1.0}))


def test_a_source_without_target_goes(spark):
    docs = table(spark, [row(i, prose(i, 10), "en", "ab"[i % 2]) for i in range(10)])
    got = x.document_rates(docs, x.MixingParams(targets={"a": 1.0})).collect()
    assert {(r.source, r.rate > 0, r.copies > 0) for r in got} == {("a", True, True), ("b", False, False)}


def test_null_ids_are_spread_over_buckets(spark):
    docs = table(spark, [row(None, prose(i, 20), "en", "a") for i in range(300)] + [row(i, prose(i, 30), "en", "b") for i in range(50)])
    got = x.document_rates(docs, x.MixingParams(targets={"a": 1.0, "b": 1.0}, rows_per_bucket=10)).collect()
    assert len(got) == 350
    for s in "ab":
        assert abs(sum(r.copies - r.rate for r in got if r.source == s)) < 1
