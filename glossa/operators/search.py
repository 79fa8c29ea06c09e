"""Search over vectors: indexes built from a nested specification, semantic search of texts, reranking and vector context."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.operators import codecs, knn, store

DEPTH = 64


@dataclass(frozen=True)
class IndexSpec:
    """How neighbours are found: ``kind`` with at most one child, whose results or vectors it works on.

    flat: all rows. sq: all rows as a block codec (``codec``) decodes them. pq: all rows as a product quantiser decodes them. ivf: the rows of
    ``nprobe`` of ``cells`` trained cells; a child sq or pq says in what form they are compared. lowdim: the ``k * factor`` nearest by
    the first ``dims`` dimensions, ranked exactly. refine: the ``k * factor`` nearest of the child, ranked exactly. Unknown kinds
    are flat with inner products.
    """

    kind: str = "flat"
    child: IndexSpec | None = None
    metric: str = "cosine"
    codec: str = "Q6_K"
    parts: int = 16
    bits: int = 6
    cells: int = 64
    nprobe: int = 8
    dims: int = 16
    factor: int = 10


def parse(spec: object, depth: int = 0) -> IndexSpec:
    """From [kind, child, options], child and options optional, or a kind alone; nested no deeper than DEPTH."""
    if depth >= DEPTH:
        raise ValueError(f"an index is nested deeper than {DEPTH}")
    if isinstance(spec, str):
        spec = [spec]
    if not isinstance(spec, (list, tuple)) or not spec or str(spec[0]).lower() not in ("flat", "sq", "pq", "ivf", "lowdim", "refine"):
        return IndexSpec("flat", metric="ip")
    child = parse(spec[1], depth + 1) if len(spec) > 1 and spec[1] else None
    return IndexSpec(str(spec[0]).lower(), child, **(spec[2] if len(spec) > 2 and spec[2] else {}))


@dataclass(frozen=True)
class Index:
    spec: IndexSpec
    base: DataFrame
    cells: DataFrame | None
    coded: DataFrame | None
    child: Index | None
    id_col: str = "vec_id"
    vec_col: str = "embedding"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score) of each query's k nearest rows but itself."""
        s, ids = self.spec, (self.id_col, self.vec_col)
        if s.kind in ("sq", "pq"):
            return knn.knn(queries, self.coded, k, s.metric, *ids)
        if s.kind == "ivf":
            return knn.ivf(queries, self.base if self.coded is None else self.coded, self.cells, None, k, s.nprobe, *ids)
        if s.kind == "lowdim":
            return knn.refine(queries, self.base, k, s.factor, F.slice(self.vec_col, 1, s.dims), s.metric, *ids)
        if s.kind == "refine" and self.child is not None:
            return knn.rerank(self.child.search(queries, k * s.factor), queries, self.base, k, s.metric, *ids)
        return knn.knn(queries, self.base, k, s.metric, *ids)

    def fingerprint(self) -> str:
        """Of the specification and all vectors, whatever their order: an index answers for these only."""
        r = self.base.where(F.col(self.vec_col).isNotNull()).agg(F.count("*"), F.sum(F.xxhash64(self.id_col, self.vec_col).cast("decimal(38,0)"))).first()
        return hashlib.sha256(f"{json.dumps(asdict(self.spec), sort_keys=True)}|{r[0]}|{r[1]}".encode()).hexdigest()

    def save(self, path: str) -> None:
        """The fingerprint and what was trained, so that loading trains nothing."""
        spark = self.base.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.spec), sort_keys=True), self.fingerprint())], "spec string, fingerprint string").coalesce(1).write.parquet(f"{path}/index")
        for name, part in (("cells", self.cells), ("coded", self.coded)):
            if part is not None:
                part.write.parquet(f"{path}/{name}")
        if self.child is not None:
            self.child.save(f"{path}/child")


def build(base: DataFrame, spec: IndexSpec, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """Train what the specification needs on all vectors of base."""
    child = build(base, spec.child, id_col, vec_col) if spec.child else None
    cells = knn.train_cells(base, spec.cells, id_col=id_col, vec_col=vec_col) if spec.kind == "ivf" else None
    coded = child.coded if child is not None and spec.kind == "ivf" else None
    if spec.kind == "sq":
        c = store.CODECS[spec.codec]
        coded = codecs.apply_blocks(base, id_col, vec_col, c.fit(base, id_col, vec_col)).select(id_col, F.col("decoded").alias(vec_col))
    elif spec.kind == "pq":
        coded = codecs.pq(base, id_col, vec_col, spec.parts, spec.bits).select(id_col, F.col("decoded").alias(vec_col))
    return Index(spec, base, cells, coded, child, id_col, vec_col)


def _spec_of(d: dict | None) -> IndexSpec | None:
    return None if d is None else IndexSpec(**(d | {"child": _spec_of(d["child"])}))


def load(spark: SparkSession, path: str, base: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    """The saved index, for the vectors that it was built from; other vectors are an error."""
    r = spark.read.parquet(f"{path}/index").first()
    spec = _spec_of(json.loads(r["spec"]))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = lambda name: spark.read.parquet(f"{path}/{name}") if fs.exists(at(f"{path}/{name}")) else None
    out = Index(spec, base, part("cells"), part("coded"), load(spark, f"{path}/child", base, id_col, vec_col) if spec.child else None, id_col, vec_col)
    if out.fingerprint() != r["fingerprint"]:
        raise ValueError(f"the index at {path} was built from other vectors")
    return out


Embed = Callable[[list[str]], list[list[float]]]
#: What can't be part of a query.
SPECIAL = r"[\x00-\x1f\x7f�]"


def templated(text: F.Column, role: str = "document", templates: dict[str, str] | None = None) -> F.Column:
    """A text in the template of its role ("query" or "document"), where {} stands for it."""
    template = (templates or {}).get(role, "{}")
    front, _, back = template.partition("{}")
    return F.concat(F.lit(front), text, F.lit(back))


def embedded(texts: DataFrame, id_col: str, text: F.Column, make_model: Callable[[], Embed], dims: int | None = None) -> DataFrame:
    """(id, embedding): vectors clipped to ``dims`` dimensions; a text that fails alone has a null vector, others of its batch have theirs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            model = model or make_model()
            asked = part["text"].tolist()
            try:
                vectors = list(model(asked))
                if len(vectors) != len(asked):
                    raise ValueError("another number of vectors than of texts")
            except Exception:  # one by one, so that one text's failure stays its own
                vectors = []
                for one in asked:
                    try:
                        (v,) = model([one])
                    except Exception:
                        v = None
                    vectors.append(v)
            yield pd.DataFrame({"id": part["id"], "embedding": [None if v is None else list(v)[:dims] for v in vectors]})

    some = texts.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("id is not null and text is not null")
    return some.mapInPandas(run, "id long, embedding array<float>").withColumnRenamed("id", id_col)


def semantic(queries: DataFrame, names: DataFrame, index: Index, make_model: Callable[[], Embed], k: int = 10, templates: dict[str, str] | None = None) -> DataFrame:
    """(query_id, names): for each query (query_id, text) the names (vec_id, name) of its max(k, 64) nearest rows, nearest first.

    Queries that hold control characters, or that can't be embedded, have an empty list. A query's id names no row of the index.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").where("query_id is not null")
    fine = asked.where(~F.coalesce(F.col("text").rlike(SPECIAL), F.lit(True))).select((-F.col("query_id") - 1).alias(index.id_col), "text")
    vectors = embedded(fine, index.id_col, templated(F.col("text"), "query", templates), make_model).where("embedding is not null").withColumnRenamed("embedding", index.vec_col)
    hits = index.search(vectors, max(k, 64)).join(names.select(F.col("vec_id"), F.col("name")), "vec_id")
    lists = hits.groupBy((-F.col("query_id") - 1).alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    return asked.select("query_id").join(lists, "query_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def reranked(candidates: DataFrame, make_scorer: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> DataFrame:
    """(query_id, candidate, score): the best of each query's candidates (query_id, query, candidate) by a scorer of pairs of texts.

    A query's only candidate is taken without a call and has no score. Of equal scores the first text in order wins; pairs that can't be
    scored come last.
    """
    many = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = candidates.select("query_id", "query", "candidate").join(many, "query_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for part in parts:
            scorer = scorer or make_scorer()
            try:
                scores = [float(x) for x in scorer(part["query"].tolist(), part["candidate"].tolist())]
            except Exception:
                scores = [None] * len(part)
            yield pd.DataFrame({"query_id": part["query_id"], "candidate": part["candidate"], "score": scores})

    scored = rows.where("n > 1").select("query_id", "query", "candidate").mapInPandas(run, "query_id long, candidate string, score double")
    alone = rows.where("n = 1").select("query_id", "candidate", F.lit(None).cast("double").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "candidate")
    best = scored.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return best.unionByName(alone)


def vector_context(rows: DataFrame, done: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, context): each row's k nearest done rows by cosine as "source=target", nearest first; done has id, vector, source and target."""
    near = knn.knn(rows, done, k, "cosine", id_col, vec_col).join(done.select(F.col(id_col).alias("vec_id"), F.concat("source", F.lit("="), "target").alias("_t")), "vec_id")
    lists = near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]).alias("context"))
    return rows.select(F.col(id_col)).join(lists.withColumnRenamed("query_id", id_col), id_col, "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
