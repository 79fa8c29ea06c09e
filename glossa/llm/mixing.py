"""Mixing sources to target weights by entropy balancing.

Rates r minimise sum t (r log r - r + 1), t a document's tokens, under exact token constraints: each source has its target share of
the token budget and each language keeps its natural share. The dual is convex and smooth; its optimum gives
r = exp(lambda_source + lambda_language). Newton's gradient and Hessian are sums over documents that a distributed aggregation
returns; only one number for each constraint and each pair of constraints that share documents comes to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class MixingParams:
    #: Target token shares by source, or None for shares in proportion to (natural share) ** temperature.
    targets: Mapping[str, float] | None = None
    temperature: float = 0.5
    #: Tokens of the mixture as a multiple of those of the documents.
    budget: float = 1.0
    tolerance: float = 1e-10
    max_iterations: int = 60
    #: Rows (of documents) for each bucket of the prefix sum that rounds rates into copies.
    rows_per_bucket: int = 50_000


NONE = "\x00none"


def token_count(text: Column) -> Column:
    """Runs of characters that are not white space (ASCII); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Dual:
    sources: list[str]
    langs: list[str]
    lam: np.ndarray
    error: float
    iterations: int


def solve(cells: DataFrame, p: MixingParams = MixingParams()) -> Dual:
    """Damped Newton on the dual over cells (src, lng, tokens): documents of one source and language have equal rates, so their tokens may be added up first.

    Cells without tokens bear no constraint. If no rates meet all constraints (a language that only one source has), the steps
    converge to the least-squares residual of the constraints, and error holds the largest relative miss.
    """
    spark = cells.sparkSession
    live = cells.where("tokens > 0")
    by_source = {r[0]: float(r[1]) for r in live.groupBy("src").agg(F.sum("tokens")).collect()}
    by_lang = {r[0]: float(r[1]) for r in live.groupBy("lng").agg(F.sum("tokens")).collect()}
    sources, langs = sorted(by_source), sorted(by_lang)
    total = sum(by_source.values())
    if not sources:
        return Dual([], [], np.zeros(0), 0.0, 0)
    if p.targets is None:
        share = np.array([(by_source[s] / total) ** p.temperature for s in sources])
    else:
        share = np.array([max(0.0, float(p.targets.get(s, 0.0))) for s in sources])
    if share.sum() <= 0:
        raise ValueError("no source that has tokens has a positive target")
    share = share / share.sum()
    goal = np.concatenate((share, [by_lang[x] / total for x in langs])) * p.budget
    at = {("s", s): i for i, s in enumerate(sources)} | {("l", x): len(sources) + i for i, x in enumerate(langs)}
    index = spark.createDataFrame([(s, at["s", s]) for s in sources], "src string, i int"), spark.createDataFrame([(x, at["l", x]) for x in langs], "lng string, j int")
    rows, _ = written(live.join(index[0], "src").join(index[1], "lng").groupBy("i", "j").agg((F.sum("tokens") / F.lit(total)).alias("t")), "cells")
    zero = np.concatenate((share <= 0, np.zeros(len(langs), bool)))
    lam = np.where(zero, -745.0, np.log(p.budget) / 2)

    def sums(points: np.ndarray) -> list[tuple[float, np.ndarray, list]]:
        """The dual's value, its gradient and the masses of the pairs (i, j) at each point, in one job."""
        shared = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(points)], "k int, lam array<double>")
        got = rows.crossJoin(F.broadcast(shared)).groupBy("k", "i", "j").agg(F.sum(F.col("t") * F.exp(F.expr("lam[i] + lam[j]"))).alias("m")).collect()
        out = []
        for k, x in enumerate(points):
            pairs = sorted((r["i"], r["j"], r["m"]) for r in got if r["k"] == k)
            g = np.zeros(len(goal))
            for i, j, m in pairs:
                g[i] += m
                g[j] += m
            out.append((sum(m for _, _, m in pairs) - float(goal[~zero] @ x[~zero]), g - goal, pairs))
        return out

    steps = 0
    value, grad, pairs = sums(np.array([lam]))[0]
    while steps < p.max_iterations and np.abs(grad[~zero]).max() > p.tolerance:
        hess = np.zeros((len(goal), len(goal)))
        for i, j, m in pairs:
            hess[i, i] += m
            hess[j, j] += m
            hess[i, j] += m
            hess[j, i] += m
        # Sources and languages add up to the same total, so one direction is free: the least-norm solution leaves it alone.
        step = np.zeros(len(goal))
        free = np.flatnonzero(~zero)
        step[free] = -np.linalg.lstsq(hess[np.ix_(free, free)], grad[free], rcond=1e-13)[0]
        step *= min(1.0, 8.0 / max(1e-300, np.abs(step).max()))
        sizes = 0.5 ** np.arange(8)
        tried = sums(lam + sizes[:, None] * step)
        best = min(range(len(tried)), key=lambda k: (tried[k][0] if np.isfinite(tried[k][0]) else np.inf, k))
        steps += 1
        if not tried[best][0] <= value + 1e-15:
            break
        stalled = value - tried[best][0] < 1e-16 and np.abs(tried[best][1][~zero]).max() >= np.abs(grad[~zero]).max()
        lam = lam + sizes[best] * step
        value, grad, pairs = tried[best]
        if stalled:
            break
    return Dual(sources, langs, lam, float(np.abs(grad[~zero] / goal[~zero]).max()), steps)


def document_rates(docs: DataFrame, p: MixingParams = MixingParams(), token_col: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens, rate, copies) of every row of docs.

    Copies are the steps of the running sum of rates within a source (in the order of a hash of doc_id and text), rounded to whole numbers:
    each document gets the floor or the ceiling of its rate and a source's copies differ from its sum of rates by less than 1. The
    running sum is taken over buckets of bounded size, so a hot source doesn't fall to one task.

    Up to 100,000 sources their bucket counts are broadcast, beyond that they are joined by a shuffle; the rows are the same. A null source
    or language is a category of its own. A text that is null or blank has 0 tokens; it bears no constraint and has
    the rate of its source and language, or 1 where these have no tokens at all. Repeated rows count as often as they occur. A
    source that targets leave out has rate 0. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    tokens = F.coalesce(F.col(token_col).cast("long"), F.lit(0)) if token_col else token_count(F.col("text").cast("string"))
    # Equal ids (null, say) are told apart by their text, so that they don't fall into one bucket.
    place = F.xxhash64("doc_id", F.col("text").cast("string")) if "text" in [c.lower() for c in docs.columns] else F.xxhash64("doc_id")
    lean, _ = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), tokens.alias("tokens"), place.alias("_h")), "tokens")
    lean = lean.withColumn("src", F.coalesce("source", F.lit(NONE))).withColumn("lng", F.coalesce("lang", F.lit(NONE)))
    dual = solve(lean.groupBy("src", "lng").agg(F.sum("tokens").alias("tokens")), p)
    weights = spark.createDataFrame([(s, float(dual.lam[i])) for i, s in enumerate(dual.sources)] or [(NONE, 0.0)], "src string, ls double")
    other = spark.createDataFrame([(x, float(dual.lam[len(dual.sources) + i])) for i, x in enumerate(dual.langs)] or [(NONE, 0.0)], "lng string, ll double")
    rated = lean.join(weights, "src", "left").join(other, "lng", "left")
    rate = F.when(F.col("ls").isNull() | F.col("ll").isNull(), F.lit(1.0)).otherwise(F.exp(F.col("ls") + F.col("ll")))
    count = lean.groupBy("src").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(p.rows_per_bucket))).cast("long").alias("buckets"))
    u = rated.withColumn("rate", F.round(rate, 9)).join(F.broadcast(count) if len(dual.sources) <= 100_000 else count, "src")
    u = u.withColumn("_b", F.pmod("_h", "buckets"))
    totals = u.groupBy("src", "_b").agg(F.sum("rate").alias("part"))
    before = totals.withColumn("base", F.coalesce(F.sum("part").over(Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("part")
    inside = Window.partitionBy("src", "_b").orderBy("_h", "doc_id", "tokens", "lng").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = u.withColumn("_c", F.sum("rate").over(inside)).join(before, ["src", "_b"])
    # Half a unit in the ninth place keeps whole sums of rounded rates whole.
    here, last = F.floor(F.col("base") + F.col("_c") + F.lit(5e-7)), F.floor(F.col("base") + F.col("_c") - F.col("rate") + F.lit(5e-7))
    return run.select("doc_id", "source", "lang", "tokens", "rate", (here - last).cast("long").alias("copies"))


def mixed(docs: DataFrame, p: MixingParams = MixingParams()) -> DataFrame:
    """docs with every document as often as its copies say, and the columns rate and copy (1, 2, ...); these replace columns of the same names.

    Rows that share a doc_id (null included) get the largest rate and copies among them. Texts that are null, empty or blank stay with the
    rate of their source and language; repeated rows are repeated each; an empty table gives an empty result; columns of any other name
    stay.
    """
    names = [c for c in docs.columns if c.lower() not in ("rate", "copy")]
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key = f"c{[c.lower() for c in names].index('doc_id')}"
    rates = document_rates(docs, p).groupBy(F.col("doc_id").alias("id")).agg(F.max("rate").alias("rate"), F.max("copies").alias("copies")).where("copies > 0")
    joined = base.join(rates.hint("shuffle_hash"), base[key].eqNullSafe(rates["id"]))
    return joined.select(*base.columns, "rate", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).toDF(*names, "rate", "copy")
