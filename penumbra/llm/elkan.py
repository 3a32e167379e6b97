"""Operator 11: vector codes by Elkan's form of Lloyd's algorithm.

Vectors become whole numbers and are cut into parts; each part position has a
codebook. A round assigns every part to its nearest entry and moves every entry
to the mean of its parts. Between rounds a table keeps, for each part of each
vector, its entry, an upper bound of its distance to that entry and a lower
bound of the distance to every entry. When entries move, the bounds move by as
much. An entry is left out of a comparison if the upper bound is strictly below
its lower bound, or strictly below half the distance between the two entries;
so entries at equal distance are always compared, by whole numbers, and the
lower index wins. Bounds are stored in few bits, rounded to the safe side: they
decide what is compared and never what wins.

Only codebooks and their sums, which have a fixed size, reach the driver. A
round writes one table, so a lost executor costs no earlier round.

Null vectors, vectors without components and vectors with a null or non-finite
component are dropped. Vectors of different lengths, lengths that parts don't
divide, and components so large that squared distances leave 64 bits are errors.
Null ids come last in the choice of the first entries; repeated ids are rows of
their own, ordered by their vectors. Fewer vectors than entries give fewer
entries; an empty table gives no rows and an empty codebook. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from penumbra.llm.shared import settle
from penumbra.llm.vectors import usable, whole, width

#: Vectors whose bounds are in memory at once, and copies of a label's total.
ROWS, SALT = 2048, 32
#: What bounds are widened by, far more than floating point rounds off.
_SAFE = 1e-9
_STATE = "x array<int>, entry binary, upper binary, step binary, lower binary, part int, code int, n long, sums array<long>"


class Bounds(NamedTuple):
    """Of one part of many vectors: entries, upper bounds, and lower bounds as multiples of a step."""

    entry: np.ndarray
    upper: np.ndarray
    step: np.ndarray
    lower: np.ndarray


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between all rows of x and c."""
    most = 2 * int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    kind = np.float64 if most * most * x.shape[1] < 1 << 52 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)


def _stored(entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> Bounds:
    """Bounds in few bits: the upper rounded up, the lower ones down."""
    step = np.nextafter((lower.max(1) / 255).astype(np.float32), np.float32(np.inf))
    counts = np.floor(lower * (1 - _SAFE) / step[:, None].astype(np.float64))
    return Bounds(entry.astype(np.uint8), np.nextafter(upper.astype(np.float32), np.float32(np.inf)), step, np.clip(counts, 0, 255).astype(np.uint8))


def first_bounds(x: np.ndarray, book: np.ndarray) -> Bounds:
    """The nearest entry of each row, by comparison with all."""
    d2 = squared(x, book)
    entry = d2.argmin(1)
    distance = np.sqrt(d2.astype(np.float64))
    return _stored(entry, distance[np.arange(len(x)), entry] * (1 + _SAFE), distance)


def moved_bounds(x: np.ndarray, old: np.ndarray, book: np.ndarray, bounds: Bounds) -> Bounds:
    """The nearest entry of each row after the entries moved from ``old`` to ``book``."""
    move = np.sqrt(((book - old) ** 2).sum(1).astype(np.float64)) * (1 + _SAFE)
    half = np.sqrt(squared(book, book).astype(np.float64)) / 2 * (1 - _SAFE)
    entry = bounds.entry.astype(np.int64)
    upper = bounds.upper + move[entry]
    lower = np.maximum(bounds.lower * bounds.step[:, None].astype(np.float64) * (1 - _SAFE) - move, 0)

    def open_(rows: np.ndarray) -> np.ndarray:
        of = entry[rows]
        out = (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= half[of])
        out[np.arange(len(rows)), of] = False
        return out

    every = np.arange(len(x))
    rows = every[open_(every).any(1)]
    own = ((x[rows] - book[entry[rows]]) ** 2).sum(1)
    upper[rows] = np.sqrt(own.astype(np.float64)) * (1 + _SAFE)
    lower[rows, entry[rows]] = np.sqrt(own.astype(np.float64))
    left = open_(rows)
    at, other = np.nonzero(left)
    if len(at):
        d2 = ((x[rows[at]] - book[other]) ** 2).sum(1)
        lower[rows[at], other] = np.sqrt(d2.astype(np.float64))
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        least = np.minimum.reduceat(d2, starts)
        sizes = np.diff(np.append(starts, len(at)))
        # the first of a row's equals has the lowest index
        best = np.minimum.reduceat(np.where(d2 == np.repeat(least, sizes), other, len(book)), starts)
        who = at[starts]
        wins = (least < own[who]) | (least == own[who]) & (best < entry[rows[who]])
        entry[rows[who[wins]]] = best[wins]
        upper[rows[who[wins]]] = np.sqrt(least[wins].astype(np.float64)) * (1 + _SAFE)
    return _stored(entry, upper, lower)


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    """Rows of the parts' arrays side by side, as bytes."""
    joined = np.ascontiguousarray(np.concatenate([a.reshape(len(a), -1) for a in arrays], axis=1))
    width = joined.dtype.itemsize * joined.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(joined), [None, pa.py_buffer(joined.tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: type, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), parts, -1)


def _round(batches: Iterator[pa.RecordBatch], names: list[str], vector: str | None, old: np.ndarray | None, book: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows with their new bounds, then the task's sums by part and entry."""
    parts, entries, dims = book.shape
    n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dims), np.int64)
    kept_types: list[pa.DataType] = []
    for whole_batch in batches:
        kept_types = kept_types or [whole_batch.schema.field(c).type for c in names]
        for first in range(0, whole_batch.num_rows, ROWS):
            batch = whole_batch.slice(first, ROWS)
            if vector is not None:
                x = whole(batch.column(vector), parts * dims)
            else:
                x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, parts * dims)
                held = [_unpacked(batch.column(c), kind, parts) for c, kind in (("entry", np.uint8), ("upper", np.float32), ("step", np.float32), ("lower", np.uint8))]
            found = []
            for p in range(parts):
                own = x[:, p * dims : (p + 1) * dims]
                if vector is not None:
                    found.append(first_bounds(own, book[p]))
                else:
                    entry, upper, step, lower = (h[:, p] for h in held)
                    found.append(moved_bounds(own, old[p], book[p], Bounds(entry[:, 0], upper[:, 0].astype(np.float64), step[:, 0], lower)))
                order = np.argsort(found[p].entry, kind="stable")
                codes, starts = np.unique(found[p].entry[order], return_index=True)
                n[p, codes] += np.diff(np.append(starts, len(x)))
                sums[p, codes] += np.add.reduceat(own[order], starts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts * dims, pa.int32()), pa.array(x.ravel().astype(np.int32)))
            state = [lists, *(_packed([f[k] for f in found]) for k in range(4))]
            blank = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *state, *blank], [*names, "x", "entry", "upper", "step", "lower", "part", "code", "n", "sums"])
    part, code = np.nonzero(n)
    if m := len(part):
        totals = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * dims, pa.int32()), pa.array(sums[part, code].ravel()))
        blank = [pa.nulls(m, t) for t in (pa.list_(pa.int32()), *[pa.binary()] * 4)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in kept_types), *blank, pa.array(part, pa.int32()), pa.array(code, pa.int32()), pa.array(n[part, code]), totals], [*names, "x", "entry", "upper", "step", "lower", "part", "code", "n", "sums"])


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The means of the parts of each entry, rounded down; unused entries stay."""
    dims = book.shape[2]
    partial_sums = state.filter("code IS NOT NULL").select("part", "code", "n", *(F.col("sums")[k].cast("decimal(38,0)").alias(f"s{k}") for k in range(dims)))
    totals = partial_sums.groupBy("part", "code").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(dims)))
    out = book.copy()
    for r in totals.collect():  # a row for each entry of a codebook
        out[r["part"], r["code"]] = [int(r[f"s{k}"]) // r["n"] for k in range(dims)]
    return out


def _codes(batches: Iterator[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, dims = book.shape
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, parts, dims)
        entry = _unpacked(batch.column("entry"), np.uint8, parts)[:, :, 0] if len(x) else np.zeros((0, parts), np.uint8)
        error = ((x - book[np.arange(parts), entry]) ** 2).sum((1, 2))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([bytes(e).hex() for e in entry], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """The id (under its name), code, error and label_error of each vector, and the codebooks (part, entry, component).

    ``error`` is the squared distance of whole numbers between vector and
    entries, ``label_error`` its sum over the rows of a label; null labels
    count as one.
    """
    if entries > 256:
        raise ValueError("an entry's index takes one byte")
    vectors = df.filter(usable(F.col(f"`{vector_col}`"))).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    dims = width(vectors, "vector")
    if dims % parts:
        raise ValueError(f"{parts} parts don't divide {dims} components")
    kept = [f for f in vectors.schema.fields if f.name != "vector"]
    result = StructType([*kept, *StructType.fromDDL("code string, error long").fields])
    spark = df.sparkSession
    largest = vectors.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()[0] or 0
    if dims * (2 * (1024 * largest + 1)) ** 2 >= 2**62 or 1024 * largest >= 2**31 - 1:
        raise ValueError("squared distances of such components don't fit 64 bits")
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    starts = np.floor(1024 * np.array([r["vector"] for r in first], np.float64).reshape(len(first), dims)).astype(np.int64)
    book = np.ascontiguousarray(starts.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
    if not dims:
        coded = spark.createDataFrame([], result)
    else:
        names, schema = ["id", "label"], StructType([*kept, *StructType.fromDDL(_STATE).fields])
        state = settle(vectors.mapInArrow(partial(_round, names=names, vector="vector", old=None, book=book), schema), "bounds")
        for _ in range(rounds):
            old, book = book, _moved(state, book)
            state = settle(state.filter("code IS NULL").drop("part", "code", "n", "sums").mapInArrow(partial(_round, names=names, vector=None, old=old, book=book), schema), "bounds")
        coded = settle(state.filter("code IS NULL").select("id", "label", "x", "entry").mapInArrow(partial(_codes, book=book), result), "codes")
    # a total goes to each of the slices that a label's rows are dealt to
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    sliced = coded.withColumn("own", F.pmod(F.xxhash64("id", "code"), F.lit(SALT)))
    joined = sliced.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("slice")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error"), book
