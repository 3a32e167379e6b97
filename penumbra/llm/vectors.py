"""Vectors of whole numbers, from array columns of real ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite; a null vector or component is not usable."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def width(vectors: DataFrame, vector: str) -> int:
    """The common length of all vectors, 0 of an empty table; different lengths are an error."""
    least, most = vectors.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components")
    return least or 0


def whole(column: pa.Array, dims: int, shift: int = 0) -> np.ndarray:
    """floor(1024 x) + shift of every component, a row for each vector."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = np.floor(1024 * x)
    if x.size and np.abs(x).max() >= 1 << 52:
        raise ValueError("components of 2^42 and more have no exact whole numbers")
    return x.astype(np.int64) + shift
