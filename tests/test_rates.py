from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from glossa.streaming import rates, runner


def slow(rows, rpm, tpm, seconds):
    """Admitted event ids of (event_id, key, ts, size), by the definition."""
    out, kept = set(), {}
    for event, key, ts, size in sorted(rows, key=lambda r: (r[2], r[0])):
        live = kept[key] = [(t, s) for t, s in kept.get(key, []) if t > ts - pd.Timedelta(seconds=seconds)]
        if len(live) < rpm and sum(s for _, s in live) + size <= tpm:
            live.append((ts, size))
            out.add(event)
    return out


def events(n: int) -> list:
    r = np.random.default_rng(3)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, 40 * n, n), unit="ms")
    return [(i, "ab"[k], t.floor("us"), float(s)) for i, (k, t, s) in enumerate(zip(r.integers(0, 2, n), at, r.integers(1, 9, n), strict=True))]


def test_limits_on_a_stream_and_answers_by_parts(spark, tmp_path, monkeypatch):
    rows = events(900)
    spark.createDataFrame([(e, k, t.to_pydatetime(), s) for e, k, t, s in rows], "event_id long, k string, ts timestamp, size double").coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    got = runner.finished(spark, str(tmp_path / "e.parquet"), lambda e: rates.limited(e, "k", "ts", "size", 4, 18.0, 2), "append").collect()
    assert {r.event_id for r in got if r.admitted} == slow(rows, 4, 18.0, 2) and len(got) == 900
    assert {r.event_id: r.ts for r in got} == {e: t.to_pydatetime() for e, _, t, _ in rows}


def test_a_key_of_many_rows_leaves_by_parts(monkeypatch):
    """No frame holds more than PART answers, whatever the number of the key's rows."""
    pytest.importorskip("pyspark")
    steps = []

    class Frame:
        def __getattr__(self, _):
            return lambda *a, **k: steps.append(a[0]) or self if a and callable(a[0]) else self

    monkeypatch.setattr(rates.F, "col", lambda _: Frame())
    rates.limited(Frame(), "k", "ts", "size", 2, 10.0, 5)

    class State:
        exists = False

        def update(self, x):
            self.kept = x

    monkeypatch.setattr(rates, "PART", 100)
    rows, state = events(950), State()
    frame = pd.DataFrame([(e, t, s) for e, _, t, s in rows], columns=["event_id", "ts", "size"])
    out = list(steps[0](("a",), iter([frame[:400], frame[400:]]), state))
    assert [len(x) for x in out] == [100] * 9 + [50] and len(state.kept[0]) <= 2
    assert set(pd.concat(out).query("admitted").event_id) == slow([(e, "a", t, s) for e, _, t, s in rows], 2, 10.0, 5)
