"""Vectors of integers, for operators whose results must not depend on rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LARGEST = 1 << 27  # of a component's size: sums of products then fit 64 bits for up to 512 components


def floats(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors of a list column, None for a null vector or one with a null or non-finite component."""
    out: list[np.ndarray | None] = [None] * len(column)
    flat = column.flatten()
    sizes = np.where(column.is_valid().to_numpy(False), column.value_lengths().fill_null(0).to_numpy(), 0)
    end = np.cumsum(sizes)
    null = flat.is_null().to_numpy(False)
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(null | ~np.isfinite(x))))
    valid = column.is_valid().to_pylist()
    for i, (e, n) in enumerate(zip(end.tolist(), sizes.tolist(), strict=True)):
        if valid[i] and bad[e] == bad[e - n]:
            out[i] = x[e - n:e]
    return out


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float, dims: int | None = None, label: Column | None = None) -> DataFrame:
    """(vec_id, label, uid, q): q = floor(scale * x) of every vector without null or non-finite components.

    Vectors of another length than ``dims`` (where given) and, if a label is
    asked for, rows without one are left out.  ``uid`` tells repeated rows
    apart; store the result before it is read twice.  A component beyond
    LARGEST after scaling is an error, since sums would not fit 64 bits.
    """
    def one(batch):
        found = floats(batch.column("vec"))
        at = [i for i, v in enumerate(found) if v is not None and (dims is None or len(v) == dims)]
        q = [np.floor(found[i] * scale) for i in at]
        flat = np.concatenate(q) if q else np.empty(0)
        if len(flat) and np.abs(flat).max() > LARGEST:
            raise ValueError(f"a component is beyond {LARGEST} after scaling by {scale}")
        ends = np.concatenate(([0], np.cumsum([len(v) for v in q]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in ("vec_id", "label", "uid")),
                                           pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))], names=["vec_id", "label", "uid", "q"])
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.lit(0) if label is None else label).cast("long").alias("label"),
                          F.monotonically_increasing_id().alias("uid"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    if label is not None:
        rows = rows.where("label is not null")
    return map_batches(rows, one, "vec_id long, label long, uid long, q array<int>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of one length of a list column as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), dims)
