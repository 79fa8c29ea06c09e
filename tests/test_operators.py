from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.operators import codecs, enrich, knn, ordered, relational, store

ROOT = Path(__file__).resolve().parent.parent


def slow_greedy(sizes, budget):
    out, cur, group = [], 0, 0
    for s in sizes:
        if cur + s > budget:
            cur, group = 0, group + 1
        cur += s
        out.append(group)
    return out


@settings(max_examples=300)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(0, 40), st.integers(0, 60))
def test_greedy_equals_the_loop_however_it_is_cut(sizes, budget, cut):
    want = slow_greedy(sizes, budget)
    a, *state = ordered.greedy(np.array(sizes[:cut], np.int64), budget)
    b, *_ = ordered.greedy(np.array(sizes[cut:], np.int64), budget, *state)
    assert a.tolist() + b.tolist() == want


def test_running_sums_across_buckets(spark):
    rows = [("a" if i % 3 else None, i * 7 - 50, None if i % 11 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.s for r in ordered.running(df, ["k"], "o", F.col("v"), "s", width=64).collect()}
    total: dict = {}
    for k, o, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
        assert got[k, o] == total[k]
    assert {r.position for r in ordered.positioned(df.where("k is null"), ["k"], "o", width=10).collect()} == set(range(67))


def test_balanced_batches(spark):
    for n, size in ((1, 5.0), (7, 2.5), (23, 4.0), (100, 7.5)):
        got = ordered.balanced_batches(spark.range(n).withColumn("k", F.lit(1)), ["k"], "id", size).collect()
        groups = max(1, round(n / size))
        base, rem = divmod(n, groups)
        sizes = [base + ((g + 1) * rem // groups > g * rem // groups) for g in range(groups)]
        assert [sum(r.batch == g for r in got) for g in range(groups)] == sizes
        assert [r.batch for r in sorted(got, key=lambda r: r.id)] == sorted(r.batch for r in got)


def test_model_calls_retry_and_fall_back(spark):
    def make():
        calls = []

        def model(texts):
            calls.append(texts)
            if "boom" in texts:
                raise RuntimeError("no")
            return [t.upper() for t in texts] if len(texts) < 3 else texts[:-1]

        return model

    b = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["x", "boom"]), (4, []), (5, None)], "batch long, texts array<string>")
    got = {(r.batch, r.pos): (r.answer, r.error) for r in enrich.enriched(b, make).collect()}
    assert got == {(1, 0): ("A", None), (1, 1): ("B", None), (2, 0): ("A", None), (2, 1): ("B", None), (2, 2): ("C", None), (3, 0): ("X", None), (3, 1): (None, "RuntimeError: no")}
    again = {(r.batch, r.pos): r.answer for r in enrich.refined(b, [make, lambda: lambda texts: [t + "!" for t in texts]]).collect()}
    assert again[1, 0] == "A!" and again[3, 1] is None and again[3, 0] == "X!"


def test_embedding_of_distinct_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None)], "id long, text string")
    got = {r.id: r.vector for r in enrich.embedded(df, "text", lambda: lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got == {1: [1.0], 2: [1.0], 3: [2.0], 4: None}


def test_eviction_and_last_wins(spark):
    c = spark.createDataFrame([("a", 10, 0), ("b", 1, 0), ("c", 1, 95), ("d", 50, 0)], "key string, freq long, born long")
    assert [r.key for r in relational.evicted(c, F.lit(100), 10, 0.05, 2).collect()] == ["d", "c"]
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("j", 1, "y")], "k string, p int, v string")
    assert {r.k: r.v for r in relational.last_wins(df, ["k"], ["p"]).collect()} == {"k": None, "j": "y"}


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([1, 2, 3, 4, 5, 6, 8, 12]), st.integers(1, 70), st.integers(0, 2**31))
def test_packing_round_trip(bits, d, seed):
    codes = np.random.default_rng(seed).integers(0, 1 << bits, (3, d))
    assert (codecs.unpack(codecs.pack(codes, bits), bits, d) == codes).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(0, 2**31))
def test_ternary_round_trip(d, seed):
    codes = np.random.default_rng(seed).integers(0, 3, (2, d))
    assert (codecs.unpack_ternary(codecs.pack_ternary(codes), d) == codes).all()


def test_block_codes_are_within_half_a_step():
    x = np.random.default_rng(0).normal(size=(20, 64))
    codes, low, span = codecs.encode_blocks(x, 32, 255, 1.0)
    back = (codes.reshape(20, 2, 32) / 255 * span.reshape(20, 2, 1) + low.reshape(20, 2, 1)).reshape(20, 64)
    assert (np.abs(back - x) <= span.reshape(20, 2, 1).repeat(32, 2).reshape(20, 64) / 510 + 1e-9).all()


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """A copy without the llm folders and the pipeline imports and has the engine's queries."""
    import shutil

    shutil.copytree(ROOT / "glossa", tmp_path / "glossa", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine_top10' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_no_module_outside_uses_the_subpackage():
    for p in (ROOT / "glossa").rglob("*.py"):
        if "llm" not in p.parts:
            assert "glossa.llm" not in p.read_text(encoding="utf-8"), p


def vectors(spark, n: int, d: int, seed: int = 0, clusters: int = 0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    if clusters:
        x += 4 * r.normal(size=(clusters, d))[r.integers(0, clusters, n)]
    return spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_a_store_is_decoded_from_its_bytes(spark, tmp_path):
    df = vectors(spark, 60, 128)
    x = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    store.CODECS["Q4_K_128"] = store.Codec(15, 128)
    for name, worst in (("Q4_K_128", 0.2), ("Q8_K_M", 0.02), ("TQ1_K_M", 1.0)):
        s = store.write(df, str(tmp_path / name), name)
        again = store.open_store(spark, str(tmp_path / name))
        assert again.fingerprint() == s.fingerprint()
        back = {r.vec_id: np.array(r.embedding) for r in again.vectors().collect()}
        assert np.sqrt(np.mean([(back[i] - x[i]) ** 2 for i in x])) < worst
        if name == "Q4_K_128":
            assert s.bits_per_dimension() == 4.25  # four bits, and two 16-bit numbers for each block of 128
        before = s.fingerprint()
        again.append(df.withColumn("vec_id", F.col("vec_id") + 1000).unionByName(spark.createDataFrame([(None, [1.0] * 128), (5, None)], df.schema)))
        assert again.coded().count() == 120 and again.fingerprint() != before
        assert np.allclose({r.vec_id: np.array(r.embedding) for r in again.vectors().collect()}[1007], back[7])


def test_trained_codebooks_use_all_vectors(spark):
    """Distributed fits equal those in one place, and a rare cluster that no sample need hold gets a centroid."""
    df = vectors(spark, 400, 8, 1, 5).repartition(3)
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    start = codecs.seeds((df, "vec_id", "embedding"), 6)
    want = start
    for _ in range(7):
        a = codecs.assign(x, want)
        want = np.array([x[a == k].mean(0) if (a == k).any() else want[k] for k in range(6)])
    assert np.allclose(codecs.kmeans((df, "vec_id", "embedding"), 6, 7), want, atol=1e-5)
    u = np.random.default_rng(2).normal(size=20_000)
    assert np.allclose(codecs.lloyd_max_of(codecs.histogram(u), 4), codecs.lloyd_max(u, 4), atol=0.02)
    mean, r, books = codecs.fit_opq((df, "vec_id", "embedding"), 2, 3, 8)
    assert np.allclose(r @ r.T, np.eye(8), atol=1e-8) and np.allclose(mean, x.mean(0), atol=1e-5)
    rotated = ((codecs.decode_pq(codecs.encode_pq((x - mean) @ r, books), books) @ r.T + mean - x) ** 2).mean()
    plain = codecs.fit_pq((df, "vec_id", "embedding"), 2, 3)
    assert rotated <= ((codecs.decode_pq(codecs.encode_pq(x, plain), plain) - x) ** 2).mean() * 1.1


def test_cells_that_are_trained_find_most_neighbours(spark):
    df = vectors(spark, 600, 16, 3, 12)
    cells = knn.train_cells(df, 12, 10)
    exact = {(r.query_id, r.vec_id): r.score for r in knn.knn(df, df, 5).collect()}
    got = {(r.query_id, r.vec_id): r.score for r in knn.ivf(df, df, cells, None, 5, 4, rows=50).collect()}
    assert len(got) == len(exact) and len(set(got) & set(exact)) >= 0.9 * len(exact)
    assert all(abs(exact[p] - got[p]) < 1e-5 for p in set(got) & set(exact))
    every = {(r.query_id, r.vec_id) for r in knn.ivf(df, df, cells, None, 5, 12).collect()}
    assert every == set(exact)


def test_columns_of_any_name_are_borne(spark):
    df = spark.createDataFrame([(i % 2, i, i) for i in range(20)], "k long, o long, v long").selectExpr("*", *(f"'x' as {c}" for c in ("_base", "_b", "_v", "_n", "_g", "_x0", "hit", "position", "batch")))
    assert ordered.running(df, ["k"], "o", F.col("v"), "s").count() == 20
    got = ordered.balanced_batches(df, ["k"], "o", 4.0)
    assert {type(r.batch) for r in got.collect()} == {int} and set(got.columns) == set(df.columns)
    cache = spark.createDataFrame([(1, "y", "z")], "k long, hit string, w string")
    assert {(r.k, r.hit, r.w) for r in relational.cached(df, cache, "k").collect()} == {(1, True, "z"), (0, False, None)}


def test_percentiles_of_blocks_take_no_loop_over_rows(monkeypatch):
    """They are those of nanpercentile, which calls Python for every block of every row: padding, single values and NaNs within included."""
    v = np.random.default_rng(0).normal(size=(50, 3, 32))
    v[:, 2, 20:] = v[5, 0, 3] = v[7, 1, 1:] = np.nan
    which = [100 * (1 - 0.998), 99.8]
    want = np.nanpercentile(v, which, axis=2, keepdims=True)
    x = v.reshape(50, -1)[:, :84]
    low = np.nanmin(np.clip(v, *want), axis=2)
    monkeypatch.setattr(np, "nanpercentile", None)
    monkeypatch.setattr(np, "apply_along_axis", None)
    assert (codecs.percentiles(v, which) == want).all()
    assert np.array_equal(codecs.block_statistics(x, 32, 0.998)[1], low)
