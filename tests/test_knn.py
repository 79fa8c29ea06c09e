from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.operators import knn


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(y) for y in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def brute(qids, q, ids, v, k, metric, keep_self=False):
    """(query_id, rank, vec_id) by rounded score and id, all rows of a query id ranked together."""
    out = {}
    for i, x in zip(qids, q, strict=True):
        for j, y in zip(ids, v, strict=True):
            if keep_self or i != j:
                s = -np.linalg.norm(x - y) if metric == "l2" else x @ y if metric == "ip" else x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-300)
                out.setdefault(int(i), []).append((-round(float(s), 6), int(j)))
    return {(i, r, j, abs(s) if metric == "l2" else -s) for i, rows in out.items() for r, (s, j) in enumerate(sorted(rows)[:k], 1)}


def got(df):
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_neighbours_of_odd_rows(spark, metric):
    """Ties, copies, repeated ids, zeros, scales far apart and blocks smaller than k."""
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 6))
    x[10:30] = x[3]
    x[40] = 0
    x[50:55] *= 1e-9
    x[60:65] *= 1e4
    ids = np.arange(90)
    ids[88] = 7
    want = brute(ids, x, ids, x, 12, metric)
    df = table(spark, [*ids, 500, 501], [*x, None, [np.nan] * 6])
    assert got(knn.knn(df, df, 12, metric, rows=10)) == want
    assert got(knn.knn(df, df, 12, metric)) == want
    few = df.where("vec_id < 5")
    assert got(knn.knn(df, few, 12, metric, keep_self=True)) == brute(ids, x, ids[:5], x[:5], 12, metric, True)


def test_single_precision_loses_nothing():
    """Rows whose scores differ less than single precision can tell, in any order of blocks."""
    r = np.random.default_rng(6)
    x = r.normal(size=(1, 64)) + 1e-5 * r.normal(size=(3000, 64))
    ids = np.arange(3000)
    for metric, order in (("cosine", ids), ("l2", ids[::-1])):
        near = knn.Nearest(ids[:20], x[:20], 5, metric)
        for a in range(0, 3000, 250):
            at = order[a : a + 250]
            near.add(knn.Base(ids[at], x[at], metric))
        q, v, s = near.rows()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i in range(20):
            all_ = knn.rounded(u[i] @ u.T if metric == "cosine" else -np.linalg.norm(x[i] - x, axis=1))
            all_[i] = -np.inf
            best = np.lexsort((ids, -all_))[:5]
            assert v[q == i].tolist() == best.tolist() and np.allclose(s[q == i], all_[best], atol=2e-6)


def test_small_batches_make_whole_blocks(spark):
    """Rows that come in groups of a few are packed into blocks of ``rows``."""
    df = table(spark, range(100), np.ones((100, 4))).coalesce(1)
    groups = df.groupBy(F.floor(F.col("vec_id") / 7).alias("g")).applyInArrow(lambda t: pa.table({"id": t["vec_id"], "x": t["embedding"]}), "id long, x array<double>").coalesce(1)
    assert sorted(len(r.id) // 8 for r in knn.packed(groups, 40).collect()) == [20, 40, 40]


def test_scores_are_not_shuffled(spark):
    """Queries and base are, once each: no exchange stands above the product of blocks."""
    df = table(spark, range(50), np.random.default_rng(1).normal(size=(50, 4))).withColumn("label", F.col("vec_id") % 3)
    for out in (knn.knn(df, df, 5), knn.refine(df, df, 2, 5, F.slice("embedding", 1, 2)), knn.ivf(df, df, knn.centroids(df, "label"), "label", 5, 2), knn.knn(df, df, 5, "l2")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan.split("CartesianProduct")[0] and "Window" not in plan


def test_cells_and_coarse_forms_against_enumeration(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 8))
    ids, label = np.arange(120), np.arange(120) % 5
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, v, c in zip(ids.tolist(), x, label, strict=True)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = np.array([x[label == c].mean(0) for c in range(5)])
    want = set()
    for i in range(120):
        probes = np.lexsort((np.arange(5), -np.round(centres @ x[i], 6)))[:2]
        s = np.where(np.isin(label, probes) & (ids != i), knn.rounded(u @ u[i]), -np.inf)
        want |= {(i, k, int(j), round(float(s[j]), 6)) for k, j in enumerate(np.lexsort((ids, -s))[:4], 1)}
    assert got(knn.ivf(df, df, knn.centroids(df, "label"), "label", 4, 2, rows=16)) == want
    c = x[:, :3] / np.linalg.norm(x[:, :3], axis=1, keepdims=True)
    want = set()
    for i in range(120):
        s = np.where(ids != i, knn.rounded(c @ c[i]), -np.inf)
        wide = np.lexsort((ids, -s))[:12]
        t = knn.rounded(u[wide] @ u[i])
        want |= {(i, k, int(wide[j]), round(float(t[j]), 6)) for k, j in enumerate(np.lexsort((wide, -t))[:4], 1)}
    assert got(knn.refine(df, df, 4, 3, F.slice("embedding", 1, 3), rows=16)) == want


def test_recall_sends_no_hits_to_the_driver(spark):
    """What is broadcast is one row for each rank, not all hits."""
    truth = spark.range(40).select((F.col("id") / 4).cast("long").alias("query_id"), (F.col("id") % 4 + 1).alias("rank"), F.col("id").alias("vec_id"))
    found = truth.withColumn("rank", F.lit(5) - F.col("rank")).where("query_id < 8")
    out = knn.recall(truth, found, (1, 2, 3, 4))
    assert {r.k: r.recall for r in out.collect()} == {1: 0.0, 2: 0.0, 3: round(16 / 30, 6), 4: 0.8}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    outer = plan.index("Join LeftOuter")
    assert "Aggregate [" in plan[outer : plan.index("Join Inner", outer)]
