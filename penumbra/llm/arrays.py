"""Sums of fixed-size arrays that tasks make in chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "k int, at int, part int, counts binary"
#: Numbers of a chunk, and chunks of one place that are summed at once.
CHUNK, FAN_IN = 1 << 16, 32


def chunk_columns(k: int, array: np.ndarray) -> dict[str, pa.Array]:
    """The non-zero chunks of a task's flat float32 array, as columns of ``SCHEMA``."""
    part = TaskContext.get().partitionId()
    at = [i for i in range(0, len(array), CHUNK) if array[i : i + CHUNK].any()]
    n = len(at)
    return {
        "k": pa.array([k] * n, pa.int32()),
        "at": pa.array(at, pa.int32()),
        "part": pa.array([part] * n, pa.int32()),
        "counts": pa.array([_packed(array[i : i + CHUNK]) for i in at], pa.binary()),
    }


def _packed(chunk: np.ndarray) -> bytes:
    """Whole numbers take two or four bytes each, other values eight."""
    if 0 <= chunk.min() and chunk.max() < 1 << 32 and (chunk == np.floor(chunk)).all():
        small = chunk.max() < 65_536
        return (b"H" if small else b"I") + chunk.astype(np.uint16 if small else np.uint32).tobytes()
    return b"d" + chunk.astype(np.float64).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {b"H": np.uint16, b"I": np.uint32, b"d": np.float64}[data[:1]], offset=1).astype(np.float64)


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    total = _unpacked(group["counts"].iloc[0])
    for x in group["counts"].iloc[1:]:
        total += _unpacked(x)
    return pd.DataFrame({"k": group["k"].iloc[:1], "at": group["at"].iloc[:1], "part": group["part"].iloc[:1], "counts": [_packed(total)]})


def summed(parts: DataFrame, arrays: list[np.ndarray], tasks: int | None = None) -> list[np.ndarray]:
    """Add the chunks to the driver's flat arrays, which have a fixed size whatever the input.

    Chunks are summed in a tree, at most ``FAN_IN`` of a place at once.
    ``tasks`` is the number of tasks that made them, unless ``parts`` can tell.
    """
    tasks = tasks or parts.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("k", "at", "part").applyInPandas(_sum, SCHEMA)
    for r in parts.groupBy("k", "at").applyInPandas(_sum, SCHEMA).toLocalIterator():
        arrays[r["k"]][r["at"] : r["at"] + CHUNK] += _unpacked(bytes(r["counts"]))
    return arrays
