"""PCA, tensor-train compression and cell order of vector tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.arrow import lists, map_vectors
from glossa.operators.codecs import column_mean, seeds, totals


def covariance(df: DataFrame, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and covariance from sums of x'x: D x D numbers for each task, whatever the number of rows."""
    mean = column_mean(df, id_col, vec_col)
    d = len(mean)
    got = totals((df, id_col, vec_col), lambda x: np.append(((x - mean).T @ (x - mean)).ravel(), len(x)), d * d + 1)
    n = int(got[-1])
    return mean, got[:-1].reshape(d, d) / max(n - 1, 1), n


def pca(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, projected): centred vectors on the leading eigenvectors, each with its largest component positive."""
    mean, cov, _ = covariance(df, id_col, vec_col)
    _, vec = np.linalg.eigh(cov)
    vec = vec[:, ::-1][:, :dims]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])
    return map_vectors(df, id_col, vec_col, lambda ids, x: pa.RecordBatch.from_arrays([pa.array(ids), lists((x - mean) @ vec, pa.float64())], [id_col, "projected"]), f"`{id_col}` long, projected array<double>")


def tensor_train(x: np.ndarray, shape: tuple[int, ...], rank: int) -> list[np.ndarray]:
    """Cores of the tensor train that approximates the sample's mean outer structure: successive SVDs with the rows as first mode."""
    cores, rest, left = [], x.T.reshape(*shape, len(x)), 1
    for n in shape[:-1]:
        m = rest.reshape(left * n, -1)
        u, s, v = np.linalg.svd(m, full_matrices=False)
        r = min(rank, len(s))
        cores.append(u[:, :r].reshape(left, n, r))
        rest, left = s[:r, None] * v[:r], r
    return cores


def tt_project(x: np.ndarray, cores: list[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    out = x.reshape(len(x), 1, *shape)
    for core in cores:
        out = np.einsum("bl n..., lnr -> b r ...".replace(" ", ""), out, core)
    return out.reshape(len(x), -1)


def tt_restore(y: np.ndarray, cores: list[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    out = y.reshape(len(y), cores[-1].shape[2], shape[-1])
    for core in reversed(cores):
        out = np.einsum("br..., lnr -> bln...".replace(" ", ""), out, core)
    return out.reshape(len(y), -1)


def tensor_train_codec(df: DataFrame, id_col: str, vec_col: str, shape: tuple[int, ...] = (8, 8), rank: int = 6, sample: int = 5000) -> DataFrame:
    """(id, compressed, rmse) with cores fitted to a seeded sample."""
    cores = tensor_train(seeds((df, id_col, vec_col), sample), shape, rank)

    def run(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        y = tt_project(x, cores, shape)
        return pa.RecordBatch.from_arrays([pa.array(ids), lists(y, pa.float64()), pa.array(np.sqrt(((tt_restore(y, cores, shape) - x) ** 2).mean(1)))], [id_col, "compressed", "rmse"])

    return map_vectors(df, id_col, vec_col, run, f"`{id_col}` long, compressed array<double>, rmse double")


def cell_order(df: DataFrame, cells: DataFrame, cell_col: str, id_col: str, vec_col: str) -> DataFrame:
    """(id, position): rows by cell and by distance from its centroid, so that blocks of adjoining rows are alike."""
    d = F.aggregate(F.zip_with(F.col(vec_col), F.col("centroid"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = df.select(F.col(id_col), F.col(cell_col).cast("long").alias("cell"), F.col(vec_col)).join(cells, "cell").select(id_col, "cell", F.round(F.sqrt(d), 6).alias("distance"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("distance", id_col))
    sizes = near.groupBy("cell").agg(F.count("*").alias("n"))
    # The cells are few: their running sizes place each cell's rows without one task sorting all of them.
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return near.withColumn("r", inside).join(before, "cell").select(id_col, "cell", "distance", (F.col("base") + F.col("r") - 1).cast("long").alias("position"))
