"""Vector stores: encoded vectors with their codec's model as Parquet tables, written once, appended to, decoded lazily.

A store is a folder with ``vectors`` (id, data, meta) and ``model``, one row of JSON with the codec's name and all that decoding needs. Its
fingerprint covers the model and every encoded row, so that an index built from a store can tell whether it still fits.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.arrow import blobs, bytes_matrix, lists, map_vectors
from glossa.operators import codecs


@dataclass(frozen=True)
class Codec:
    """A block codec by name: fit, encode and decode."""

    levels: int
    block: int = 32
    centred: bool = False

    def fit(self, df: DataFrame, id_col: str, vec_col: str) -> codecs.BlockModel:
        return codecs.fit_blocks(df, id_col, vec_col, self.levels, self.block, centred=self.centred)


#: Codecs by name; further ones may be added.
CODECS: dict[str, Codec] = {f"Q{b}_K": Codec(2**b - 1) for b in (2, 3, 4, 5, 6, 8)} | {f"Q{b}_K_M": Codec(2**b - 1, centred=True) for b in (1, 2, 3, 4, 5, 6, 8)} | {"TQ1_K_M": Codec(2, centred=True)}


def encode(df: DataFrame, m: codecs.BlockModel, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, data, meta) of every row that has an id and a vector; one narrow pass."""

    def run(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        data, meta = codecs.to_bytes(x, m)
        return pa.RecordBatch.from_arrays([pa.array(ids), blobs(data), blobs(meta)], [id_col, "data", "meta"])

    return map_vectors(df, id_col, vec_col, run, f"`{id_col}` long, data binary, meta binary")


def decode(coded: DataFrame, m: codecs.BlockModel, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vector) from the bytes alone; a projection, so that only the rows that a plan asks for are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = codecs.from_bytes(bytes_matrix(b.column(1)), bytes_matrix(b.column(2)), dim, m)
                yield pa.RecordBatch.from_arrays([b.column(0), lists(x.astype(np.float32), pa.float32())], [id_col, vec_col])

    return coded.select(id_col, "data", "meta").mapInArrow(run, f"`{id_col}` long, `{vec_col}` array<float>")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    codec: str
    dim: int
    model: codecs.BlockModel
    id_col: str
    vec_col: str

    def coded(self) -> DataFrame:
        return self.spark.read.schema(f"`{self.id_col}` long, data binary, meta binary").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return decode(self.coded(), self.model, self.dim, self.id_col, self.vec_col)

    def append(self, df: DataFrame) -> None:
        """Encode more rows with the model that the store has; values beyond its ranges are clipped to them."""
        encode(df, self.model, self.id_col, self.vec_col).write.mode("append").parquet(f"{self.path}/vectors")

    def bits_per_dimension(self) -> float:
        r = self.coded().agg(F.sum(F.octet_length("data") + F.octet_length("meta")).alias("n"), F.count("*").alias("rows")).first()
        return 8 * (r["n"] or 0) / max(1, r["rows"] * self.dim)

    def fingerprint(self) -> str:
        """Of the model and all rows, whatever their order and files."""
        r = self.coded().agg(F.count("*"), F.sum(F.xxhash64(self.id_col, "data", "meta").cast("decimal(38,0)"))).first()
        return hashlib.sha256(f"{_json(self)}|{r[0]}|{r[1]}".encode()).hexdigest()


def _json(s: Store) -> str:
    m = asdict(s.model)
    m["mean"] = None if s.model.mean is None else s.model.mean.tolist()
    return json.dumps({"codec": s.codec, "dim": s.dim, "id": s.id_col, "vec": s.vec_col, "model": m}, sort_keys=True)


def write(df: DataFrame, path: str, codec: str = "Q6_K", id_col: str = "vec_id", vec_col: str = "embedding") -> Store:
    """Fit the codec on all vectors of df and write them encoded. An existing store at the path is an error."""
    spark = df.sparkSession
    first = df.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    if first is None:
        raise ValueError("a store needs a vector")
    store = Store(spark, path, codec, first[0], CODECS[codec].fit(df, id_col, vec_col), id_col, vec_col)
    encode(df, store.model, id_col, vec_col).write.parquet(f"{path}/vectors")
    spark.createDataFrame([(_json(store),)], "model string").coalesce(1).write.parquet(f"{path}/model")
    return store


def open_store(spark: SparkSession, path: str) -> Store:
    d = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
    m = d["model"]
    m["mean"] = None if m["mean"] is None else np.array(m["mean"])
    return Store(spark, path, d["codec"], d["dim"], codecs.BlockModel(**m), d["id"], d["vec"])
