"""Operator 13: near duplicates by circulant MinHash.

A text's set holds the 64-bit hashes of its distinct word shingles; their upper
halves are its elements, from a universe of 2^32. Two permutations of that
universe give the whole signature: one breaks up what order the elements have,
the other, turned by k places, gives coordinate k: the least place of any
element. So a signature of many coordinates needs no further permutations.

``ROWS`` coordinates make a band. There are as many bands as it takes for a pair
at the threshold to share none with a chance below ``LOST``. Sets that share a
band are candidates, and candidates link only by an exact comparison of their
full sets.

Large groups of near copies would make a candidate of each pair, so links are
found in two steps. First each set is compared with the least and the greatest
document of its band and size, which is linear in the group. Then only
candidates between components found so far are compared, pruned by bit maps of
the sets and taken from one of their bands alone; a band of many holders is cut into slices, and each pair of slices
meets in a task of its own.

Equal sets form one class, found by two 64-bit sums of the hashes and the size;
only a class's least id takes part in the join. Null texts and texts without
words have the empty set and link with nothing; texts of fewer words than a
shingle have one shingle, the whole. Texts of any length are read whole. Rows
of null id are in no component and are kept. Rows that share an id are one
document, with all their links. Equal rows stay. An empty table gives no rows.
Extra columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.graphs import components
from penumbra.llm.jaccard import MAP_LONGS, maps_near, sets_of, shingle_sets, verified
from penumbra.llm.shared import settle
from penumbra.llm.words import slices

SLICE_BYTES = 6 << 20
#: Coordinates of a band, and the largest chance that a pair at the threshold shares no band.
ROWS, LOST = 4, 1e-8
#: Elements whose coordinates are made at once, and holders of a band in a slice.
BLOCK, SLICE = 1 << 16, 256
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # fixed values of multiplicative hashing
_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)  # fixed values of multiplicative hashing, odd, so each step is a permutation


def n_bands(percent: int) -> int:
    """Bands that make sure of a pair at the threshold, but for a chance of ``LOST``."""
    shared = min(percent / 100, 0.999) ** ROWS
    return math.ceil(math.log(LOST) / math.log1p(-shared))


def permuted(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """The second permutation, in place."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, factor in ((16, _M1), (13, _M2)):
        x ^= np.right_shift(x, np.uint32(shift), out=spare)
        x *= factor
    x ^= np.right_shift(x, np.uint32(16), out=spare)
    return x


def scattered(x: np.ndarray) -> np.ndarray:
    """The first permutation."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return x * _M2


def signatures(sets: list[np.ndarray], n_coordinates: int) -> np.ndarray:
    """The coordinates (row) of each set (column); sets must not be empty."""
    out = np.empty((n_coordinates, len(sets)), np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends, first = np.cumsum(sizes), 0
    while first < len(sets):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
        elements = scattered((np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32))
        starts = ends[first:last] - sizes[first:last] - before
        turned, spare = np.empty_like(elements), np.empty_like(elements)
        for k in range(n_coordinates):
            np.subtract(elements, np.uint32(k), out=turned)  # turned by k places, round the universe
            out[k, first:last] = np.minimum.reduceat(permuted(turned, spare), starts)
        first = last
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band (row) of each set (column)."""
    rows = coordinates.reshape(-1, ROWS, coordinates.shape[1]).astype(np.uint64)
    key = np.repeat(np.arange(1, len(rows) + 1, dtype=np.uint64)[:, None] * _K1, rows.shape[2], axis=1)
    for r in range(ROWS):
        key ^= rows[:, r]
        key *= _K2
        key ^= key >> np.uint64(29)
    return key


def _measure(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Ids, set sizes, set keys, and the bands of sets that can link with another."""
    bands = n_bands(percent)
    for batch in slices(batches, "text", SLICE_BYTES):
        sets = shingle_sets(batch.column("text"), size)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        keys = [np.array([int(((s ^ (s >> np.uint64(31))) * k).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64) for k in (_K1, _K2)]
        able = np.flatnonzero((n > 0) & (100 * n >= percent * (n + 1)))  # smaller sets are near no different set
        found = band_keys(signatures([sets[k] for k in able], bands * ROWS)).T if len(able) else np.zeros((0, bands), np.uint64)
        offsets = np.concatenate([[0], np.cumsum(np.isin(np.arange(len(n)), able) * bands)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(k.view(np.int64)) for k in keys), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(found).ravel().view(np.int64)))],
            ["doc_id", "n", "key1", "key2", "bands"],
        )


def _sizes_near(percent: int) -> Column:
    return F.expr(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)")


def _first_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each holder of a band with the least and the greatest holder of like size."""
    sized = shared.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    ends = sized.groupBy("bucket", "size").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    both = sized.join(ends, ["bucket", "size"]).select("doc_id", F.explode(F.array("low", "high")).alias("hub")).filter("doc_id <> hub")
    return both.select(F.greatest("doc_id", "hub").alias("u"), F.least("doc_id", "hub").alias("v")).distinct()


def _second_pairs(shared: DataFrame, banded: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Candidates between different components, each from the least of the bands that the two share."""
    placed = shared.join(found, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).filter("low < high")
    cut = placed.join(mixed.select("bucket", F.ceil(F.col("m") / SLICE).alias("g")), "bucket").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("g")))
    cut = cut.join(sets.select("doc_id", *(F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(MAP_LONGS))), "doc_id")
    cut = settle(cut.join(banded.select("doc_id", "bands"), "doc_id"), "mixed")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))
    a = cut.withColumn("other", every).withColumn("cell", F.col("own") * F.col("g") + F.col("other")).alias("a")
    b = cut.withColumn("other", every).withColumn("cell", F.col("other") * F.col("g") + F.col("own")).alias("b")
    met = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.component") < F.col("b.component"))
    once = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.bucket")
    near = a.join(b, met & _sizes_near(percent) & maps_near(percent) & once)
    return near.select(F.greatest("a.doc_id", "b.doc_id").alias("u"), F.least("a.doc_id", "b.doc_id").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept of every row.

    class_id is the least id of the rows of equal sets, component_id that of all
    rows reachable by links; kept says whether the row's id is that of its
    component.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    measured = settle(rows.mapInArrow(partial(_measure, size=size, percent=percent), "doc_id long, n long, key1 long, key2 long, bands array<long>"), "signatures")
    named = measured.select("doc_id", "n", "key1", "key2")
    classes = settle(named.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("class_id")), "classes")

    heads = classes.select(F.col("class_id").alias("doc_id")).distinct()
    banded = measured.filter("doc_id IS NOT NULL AND size(bands) > 0").select("doc_id", "n", "bands").join(heads, "doc_id", "left_semi")
    held = banded.select("doc_id", "n", F.explode("bands").alias("bucket"))
    met = settle(held.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("bucket"), "buckets")
    shared = settle(held.join(met, "bucket", "left_semi"), "shared")

    first = settle(_first_pairs(shared, percent), "pairs")
    sets = sets_of(rows.filter("doc_id IS NOT NULL"), shared.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")), size)
    links = settle(verified(first, sets, percent), "links")
    second = settle(_second_pairs(shared, banded, sets, components(links), percent), "pairs")
    # rows that share an id are one document, so their classes are linked
    same_class = (named["key1"] == classes["key1"]) & (named["key2"] == classes["key2"]) & (named["n"] == classes["n"])
    labelled = settle(named.join(classes, same_class & named["doc_id"].isNotNull(), "left").select("doc_id", named["n"].alias("n"), "class_id"), "labelled")
    one = labelled.filter("class_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count("*").alias("m"))
    twice = labelled.join(one.filter("m > 1 AND low < high"), "doc_id").select(F.col("class_id").alias("u"), F.col("low").alias("v")).filter("u <> v")
    found = components(links.unionByName(verified(second, sets, percent)).unionByName(twice))

    out = labelled.join(found, F.col("class_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
