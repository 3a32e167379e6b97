"""Operator 12: whitening by the locally optimal block preconditioned conjugate gradient method (LOBPCG).

Vectors become whole numbers, so their sums are exact and every row is centred
before it is multiplied. Eigenvectors of the covariance are found without making
it: tasks multiply their centred rows with a block of directions and sum the
products, and the driver does a Rayleigh-Ritz step on the space of the present
block, its residuals and the previous directions. Steps go on until residuals of
the wanted components stop to fall, and they must then be certified: at most
``CERTIFIED`` of the largest eigenvalue.

Products of tasks are summed in a tree of fixed fan-in and in order of the
tasks, so they are the same whenever the input has the same parts. Only blocks
of directions, of a size that the rows don't change, reach the driver.

Null vectors, vectors without components and vectors with a null or non-finite
component are dropped; vectors of different lengths are an error. Components of
no variance are left out: an empty table, one vector or equal vectors give no
rows. Of equal eigenvalues any basis is taken, the same for all rows. Repeated
and null ids are rows of their own. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from penumbra.llm.shared import settle
from penumbra.llm.vectors import usable, whole, width

#: Added to every whole number.
SHIFT = 100_000
#: Products summed at once, the largest residual by the largest eigenvalue, and the most steps.
FAN_IN, CERTIFIED, MOST_STEPS = 32, 1e-10, 1000
ROWS = 8192


class Centre(NamedTuple):
    """n rows and their sums, as n * quotient + rest in each dimension."""

    n: int
    quotient: np.ndarray
    rest: np.ndarray


class Whitening(NamedTuple):
    """Components (columns of ``vectors``) by falling variance, the total variance, and the largest certified residual."""

    centre: Centre
    vectors: np.ndarray
    variances: np.ndarray
    total: float
    residual: float


def centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    """Differences from the mean: whole numbers are subtracted exactly, then the fraction."""
    return (x - centre.quotient).astype(np.float64) - centre.rest / centre.n


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            yield part, whole(part.column("vector"), dims, SHIFT)


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, [0] * dims
    for _, x in _rows(batches, dims):
        n += len(x)
        total = [a + int(b) for a, b in zip(total, x.sum(0), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total, pa.decimal128(38, 0))], ["dim", "n", "total"])


def _mapped(batches: Iterator[pa.RecordBatch], dims: int, centre: Centre, make: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sum of ``make`` over a task's centred rows."""
    total = None
    for _, x in _rows(batches, dims):
        made = make(centred(x, centre))
        total = made if total is None else total + made
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "block"])


def _added(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    total = np.zeros_like(np.frombuffer(group["block"].iloc[0]))
    for block in group["block"]:
        total = total + np.frombuffer(block)
    return pd.DataFrame({"part": (group["part"].iloc[:1] // FAN_IN).astype("int32"), "block": [total.tobytes()]})


def _total(vectors: DataFrame, tasks: int, dims: int, centre: Centre, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``make`` over all centred rows, in a tree."""
    parts = vectors.select("vector").mapInArrow(partial(_mapped, dims=dims, centre=centre, make=make), "part int, block binary")
    while True:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_added, "part int, block binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return np.frombuffer(bytes(parts.first()["block"]))


def _product(x: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The rows' share of covariance times block, and of the total variance at the end."""
    return np.append((x.T @ (x @ block)).ravel(), np.einsum("ij,ij->", x, x))


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what the block adds to the orthonormal columns of ``against``."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
    if not block.size:
        return block[:, :0]
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8 * s[0]][:, : max(0, len(block) - against.shape[1])]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.size else u


def lobpcg(multiply: Callable[[np.ndarray], np.ndarray], dims: int, components: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvectors, eigenvalues, largest residual by the largest eigenvalue) of the greatest eigenvalues of a symmetric matrix.

    The block is twice as wide as asked for, which keeps the wanted components
    apart from those that follow.
    """
    width = min(dims, 2 * components)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    residuals, previous = np.zeros((dims, 0)), np.zeros((dims, 0))
    best, waited = np.inf, 0
    for _ in range(MOST_STEPS):
        basis = block
        for more in (residuals, previous):
            basis = np.hstack([basis, orthonormal(more, basis)])
        basis = np.linalg.qr(basis)[0]
        image = multiply(basis)
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        old, block = block, basis @ turn
        residuals = image @ turn - block * values
        previous = block - old @ (old.T @ block)
        if values[0] <= 0:
            return block[:, :0], values[:0], 0.0
        now = float(np.linalg.norm(residuals[:, :components], axis=0).max() / values[0])
        waited = 0 if now < best / 2 else waited + 1
        best = min(best, now)
        if now <= CERTIFIED and (waited >= 2 or now <= 1e-15):
            return block[:, :components], values[:components], now
    raise RuntimeError(f"residuals of {best:.1e} of the largest eigenvalue after {MOST_STEPS} steps")


def fit(vectors: DataFrame, components: int) -> tuple[Whitening | None, int]:
    """The whitening of a written table with a column ``vector``, and its number of tasks."""
    dims = width(vectors, "vector")
    if not dims:
        return None, 0
    tasks = vectors.rdd.getNumPartitions()
    sums = vectors.select("vector").mapInArrow(partial(_sums, dims=dims), "dim int, n long, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = sorted((r["dim"], r["n"], int(r["total"])) for r in sums.collect())  # a row for each dimension
    n = found[0][1]
    centre = Centre(n, np.array([t // n for _, _, t in found], np.int64), np.array([t % n for _, _, t in found], np.int64))
    total = 0.0

    def multiply(block: np.ndarray) -> np.ndarray:
        nonlocal total
        made = _total(vectors, tasks, dims, centre, partial(_product, block=block)) / n
        total = float(made[-1])
        return made[:-1].reshape(dims, -1)

    block, values, residual = lobpcg(multiply, dims, components)
    some = values > 1e-12 * total
    block, values = block[:, some], values[some]
    largest = np.abs(block).argmax(0)
    block = block * np.sign(block[largest, np.arange(block.shape[1])])
    return Whitening(centre, block, values, total, residual), tasks


def _whitened(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    return x @ fitted.vectors / np.sqrt(fitted.variances)


def _moments(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    """Sums of the whitened rows and of their products."""
    w = _whitened(x, fitted)
    return np.append(w.sum(0), (w.T @ w).ravel())


def _deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """Sums over dimensions of (n x - S)^2, exactly."""
    away = x - centre.quotient
    if x.size and (int(np.abs(away).max()) + 1) ** 2 * centre.n**2 * x.shape[1] >= 1 << 62:
        away = away.astype(object)
    made = ((centre.n * away - centre.rest) ** 2).sum(1)
    return pa.array(made.tolist(), pa.decimal128(38, 0)) if made.dtype == object else pa.array(made).cast(pa.decimal128(38, 0))


def _scored(batches: Iterator[pa.RecordBatch], dims: int, fitted: Whitening) -> Iterator[pa.RecordBatch]:
    k = fitted.vectors.shape[1]
    for part, x in _rows(batches, dims):
        w = _whitened(centred(x, fitted.centre), fitted)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("id"), _deviations(x, fitted.centre), lists], ["id", "deviation", "w"])


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: the id (under its name), component, n, deviation, whitened, explained, identity_error, residual.

    ``deviation`` is a decimal; ``residual`` is the largest certified residual
    by the largest eigenvalue.
    """
    usable_rows = df.filter(usable(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    vectors = settle(usable_rows, "vectors")
    fitted, tasks = fit(vectors, components)
    spark, id_field = df.sparkSession, StructField("id", usable_rows.schema["id"].dataType)
    if fitted is None or not fitted.variances.size:
        ddl = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, residual double"
        return spark.createDataFrame([], StructType([id_field, *StructType.fromDDL(ddl).fields])).withColumnRenamed("id", id_col)
    dims, k, n = len(fitted.centre.rest), len(fitted.variances), fitted.centre.n
    moments = _total(vectors, tasks, dims, fitted.centre, partial(_moments, fitted=fitted))
    mean, products = moments[:k] / n, moments[k:].reshape(k, k) / n
    error = float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())
    scored = vectors.mapInArrow(partial(_scored, dims=dims, fitted=fitted), StructType([id_field, *StructType.fromDDL("deviation decimal(38,0), w array<double>").fields]))
    explained = F.array(*(F.lit(float(v / fitted.total)) for v in fitted.variances))
    rows = scored.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), F.lit(fitted.residual).alias("residual"),
    )
