"""Arrow columns of vectors as numpy matrices and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths, as float64; no copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def blobs(rows: np.ndarray) -> pa.Array:
    """Each row of a byte matrix as one binary value, without a loop over rows."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def bytes_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a binary column of equal lengths as a byte matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def map_vectors(df: DataFrame, id_col: str, vec_col: str, fn: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """fn(ids, matrix) over Arrow batches; rows without a vector are left out. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)))

    return df.select(id_col, vec_col).where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).mapInArrow(run, schema)
