"""Operator 2: n-gram Jaccard join with adaptive multi-match prefixes.

A text's set holds the 64-bit hashes of its distinct word shingles. Texts of
equal sets form one class, and classes are joined: two classes link if
100 * intersection >= percent * union.

All sets are ordered alike: by an estimate of how many texts hold a shingle
(counted over all texts in a sketch of fixed size), rare first. Sets that need
an overlap o share at least l of their first n - o + l shingles, for any l. Each
class takes the l (1 to ``MOST_MATCHES``) whose prefix has the least estimated
cost: rows to join and candidates to verify. A pair is a candidate if it shares
as many prefix shingles as the smaller l of the two asks for, at places that
leave enough shingles for the overlap.

Large groups of near copies would make a candidate of each pair, so links are
found in two steps. First each class is verified against the one in its
shingle's group that has the fewest rarer shingles before it, and against its
neighbour: linear in the group. Then only candidates between different
components found so far are joined and verified. This loses no connection:
linked sets are either in one component already, or a candidate of the second
step. Its join also compares bit maps of the sets: a bit that only one set has
set stands for a shingle that the other lacks, so pairs with too many of them
cannot link and leave the join at once.

Null texts and texts without words have the empty set and no links. Texts of
fewer words than a shingle have one shingle, the whole. A null id is in no
component. Rows that share an id are one document: linked to each other's
links. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penumbra.llm.arrays import SCHEMA, chunk_columns, summed
from penumbra.llm.graphs import components
from penumbra.llm.shared import settle, unused
from penumbra.llm.words import LOWER, slices, split_words

SLICE_BYTES = 6 << 20
#: Buckets of the sketch of shingle counts, and the largest number of matches asked for.
BUCKETS, MOST_MATCHES = 1 << 22, 4
#: Longs in the bit map of a set.
MAP_LONGS = 16
#: Cost of one verification, in rows of the join on shingles.
VERIFY_COST = 50
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # fixed values of multiplicative hashing


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = split_words(texts, LOWER)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.vocab.to_pylist()), np.uint64, len(words.vocab))
    h = hashes[words.codes] if len(hashes) else np.zeros(0, np.uint64)
    whole = max(0, len(h) - size + 1)
    mixed = h[:whole].copy()
    for k in range(1, size):
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * _K1 + h[k : k + whole]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _K2
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(mixed[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _measure(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of ids, set sizes and set keys; then the task's sketch of shingle counts."""
    sketch = np.zeros(BUCKETS, np.float32)
    nothing = {"k": pa.int32(), "at": pa.int32(), "part": pa.int32(), "counts": pa.binary()}
    for batch in slices(batches, "text", SLICE_BYTES):
        sets, n = shingle_sets(batch.column("text"), size), batch.num_rows
        for s in sets:
            sketch[bucket(s)] += 1  # one for each bucket of a text
        keys = [[int(((s ^ (s >> np.uint64(31))) * k).sum(dtype=np.uint64)) if len(s) else 0 for s in sets] for k in (_K1, _K2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(_long(np.array(k, np.uint64)) for k in keys), *(pa.nulls(n, t) for t in nothing.values())],
            ["doc_id", "n", "key1", "key2", *nothing],
        )
    chunks = chunk_columns(0, sketch)
    if n := len(chunks["k"]):
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), *chunks.values()], ["doc_id", "n", "key1", "key2", *chunks])


def matches_to_ask(n: int, counts: np.ndarray, least: int) -> int:
    """How many shared prefix shingles to ask for, by the estimated cost of the prefix each number needs.

    ``counts`` estimates the texts of each shingle, rare first. A candidate at
    l matches has met l times, so candidates are at most the meetings over l.
    """
    base = n - least
    lengths = np.minimum(base + np.arange(1, MOST_MATCHES + 1), n)
    meetings = np.cumsum(np.maximum(counts[: base + MOST_MATCHES] - 1, 0))[lengths - 1]
    cost = lengths + meetings * (1 + VERIFY_COST / np.arange(1, MOST_MATCHES + 1) ** 2)
    return int(cost.argmin()) + 1


def least_overlap(n: int, percent: int) -> int:
    """The smallest overlap with any partner."""
    return -(-percent * n // 100)


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, sketch) -> Iterator[pa.RecordBatch]:
    counts = sketch.value
    noise = max(1.0, float(counts.mean()))
    for batch in slices(batches, "text", SLICE_BYTES):
        ids, ns, asks, tokens = [], [], [], []
        for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), size), strict=True):
            n, least = len(s), least_overlap(len(s), percent)
            if n == 0 or 100 * n < percent * (n + 1):
                continue  # no different set is near enough to link with one so small
            seen = counts[bucket(s)]
            order = np.lexsort((s, seen))
            # what other shingles of the bucket add is taken off; half a text more stands for doubt
            ask = matches_to_ask(n, np.maximum(seen[order] - noise, 1) + 0.5, least)
            ids.append(doc_id)
            ns.append(n)
            asks.append(ask)
            tokens.append(s[order[: min(n, n - least + ask)]])
        if ids:
            flat = np.concatenate(tokens)
            offsets = np.cumsum([0] + [len(t) for t in tokens])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(asks, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _long(flat))],
                ["doc_id", "n", "ask", "tokens"],
            )


def bit_map(s: np.ndarray) -> np.ndarray:
    """``MAP_LONGS`` longs with the bits of all hashes."""
    mask = np.zeros(64 * MAP_LONGS, bool)
    mask[(s & np.uint64(64 * MAP_LONGS - 1)).astype(np.int64)] = True
    return np.packbits(mask, bitorder="little").view(np.int64)


def id_bucket(ids: np.ndarray) -> np.ndarray:
    return bucket((ids.astype(np.int64).view(np.uint64) + _K2) * _K1)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of an array that is not zero where an id falls."""
    marks = np.zeros(BUCKETS, np.float32)
    for batch in batches:
        marks[id_bucket(batch.column("doc_id").to_numpy())] = 1
    yield pa.RecordBatch.from_pydict(chunk_columns(0, marks))


def _sets(batches: Iterator[pa.RecordBatch], size: int, wanted, mapped) -> Iterator[pa.RecordBatch]:
    """The sets of documents whose id may be wanted, and the bit maps of those and of documents that may be mapped.

    Both are packed arrays of bits by hashed id.
    """
    want, either = (np.unpackbits(x).astype(bool) for x in (wanted.value, wanted.value | mapped.value))
    for whole in batches:
        batch = whole.filter(pa.array(either[id_bucket(whole.column("doc_id").to_numpy())]))
        for part in slices(iter([batch]), "text", SLICE_BYTES):
            sets, keep = shingle_sets(part.column("text"), size), want[id_bucket(part.column("doc_id").to_numpy())]
            held = [s if k else s[:0] for s, k in zip(sets, keep, strict=True)]
            offsets = np.cumsum([0] + [len(s) for s in held])
            maps = np.concatenate([bit_map(s) for s in sets])
            columns = [
                part.column("doc_id"),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _long(np.concatenate(held))),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * MAP_LONGS, pa.int32()), pa.array(maps, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hashes", "bits"])


def marked(ids: DataFrame):
    """A broadcast of packed bits by hashed id: a fixed size, whatever the number of ids (column doc_id)."""
    (marks,) = summed(ids.mapInArrow(_mark, SCHEMA), [np.zeros(BUCKETS, np.float32)])
    return ids.sparkSession.sparkContext.broadcast(np.packbits(marks > 0))


def sets_of(texts: DataFrame, pairs: DataFrame, size: int, mapped: DataFrame | None = None) -> DataFrame:
    """Written sets of the documents in ``pairs``, and bit maps of those in ``mapped`` besides."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("doc_id"))
    wanted = marked(ends)
    marks = partial(_sets, size=size, wanted=wanted, mapped=wanted if mapped is None else marked(mapped))
    return settle(texts.mapInArrow(marks, "doc_id long, hashes array<long>, bits array<long>"), "hashes")


def _near(percent: int):
    """Whether rows a and b of a shared shingle can be of a linked pair that shares l of them."""
    need = f"ceil({percent} * (a.n + b.n) / {100 + percent}D)"
    asked = "least(a.ask, b.ask)"
    return F.expr(
        f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) "
        f"AND a.pos < a.n - {need} + {asked} AND b.pos < b.n - {need} + {asked}"
    )


def maps_near(percent: int):
    """Whether the bit maps leave room for the overlap that a link needs: bits that differ stand for shingles that differ."""
    differ = " + ".join(f"bit_count(a.b{k} ^ b.b{k})" for k in range(MAP_LONGS))
    return F.expr(f"{differ} <= a.n + b.n - 2 * ceil({percent} * (a.n + b.n) / {100 + percent}D)")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are near enough."""
    a, b = (sets.select(F.col("doc_id").alias(k), F.col("hashes").alias(f"{k}_set")) for k in ("u", "v"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    return pairs.join(a, "u").join(b, "v").filter(100 * both >= percent * (F.size("u_set") + F.size("v_set") - both)).select("u", "v")


def classes_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row.

    class_id is the least id of the rows of equal sets, component_id that of all
    rows reachable by links.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = settle(rows.mapInArrow(partial(_measure, size=size), f"doc_id long, n long, key1 long, key2 long, {SCHEMA}"), "sets")
    chunks = measured.filter("counts IS NOT NULL").select("k", "at", "part", "counts")
    (sketch,) = summed(chunks, [np.zeros(BUCKETS, np.float32)], (chunks.agg(F.max("part")).first()[0] or 0) + 1)
    shared = spark.sparkContext.broadcast(sketch)
    named = measured.filter("n IS NOT NULL").select("doc_id", "n", "key1", "key2")
    classes = settle(named.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("class_id")), "classes")

    heads = classes.select(F.col("class_id").alias("doc_id")).distinct()
    prefixes = rows.filter("doc_id IS NOT NULL").mapInArrow(partial(_prefixes, size=size, percent=percent, sketch=shared), "doc_id long, n int, ask int, tokens array<long>")
    tokens = prefixes.join(heads, "doc_id", "left_semi").select("doc_id", "n", "ask", F.posexplode("tokens").alias("pos", "token"))
    group = Window.partitionBy("token")
    shared_tokens = settle(tokens.withColumn("_m", F.count("*").over(group)).filter("_m > 1").drop("_m"), "tokens")

    # the first step: against the class with the fewest rarer shingles before this one, and against the neighbour
    near_size = F.floor(F.log(F.col("n").cast("double")) / 0.08).cast("int")
    line = Window.partitionBy("token", "size").orderBy("pos", "n", "doc_id")
    sized = shared_tokens.withColumn("size", near_size)
    one = F.struct("doc_id", "n", "ask", "pos")
    sided = sized.withColumns({"hub": F.first(one).over(line), "next": F.lag(one).over(line)})
    edges = None
    for side in ("hub", "next"):
        found = sided.select(one.alias("a"), F.col(side).alias("b")).filter("a.doc_id <> b.doc_id").filter(_near(percent))
        pairs = found.select(F.greatest("a.doc_id", "b.doc_id").alias("u"), F.least("a.doc_id", "b.doc_id").alias("v"))
        edges = pairs if edges is None else edges.unionByName(pairs)
    first = settle(edges.groupBy("u", "v").agg(F.count("*").alias("m")).filter("m > 1").select("u", "v"), "pairs")

    texts = rows.filter("doc_id IS NOT NULL")
    sets = sets_of(texts, first, size, shared_tokens.select("doc_id"))
    links = settle(verified(first, sets, percent), "links")
    found = components(links)

    # the second step: candidates between different components
    placed = shared_tokens.join(found, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")
    mixed = placed.withColumns({"_low": F.min("component").over(group), "_high": F.max("component").over(group)}).filter("_low < _high").drop("_low", "_high")
    maps = sets.select("doc_id", *(F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(MAP_LONGS)))
    mixed = settle(mixed.join(maps, "doc_id"), "mixed")
    a, b = mixed.alias("a"), mixed.alias("b")
    across = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") < F.col("b.component")) & _near(percent) & maps_near(percent))
    counted = across.groupBy(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v")).agg(F.count("*").alias("m"), F.min(F.least("a.ask", "b.ask")).alias("ask"))
    second = settle(counted.filter("m >= ask").select("u", "v"), "pairs")
    more = verified(second, sets_of(texts, second, size), percent)
    found = components(links.unionByName(more))

    labelled = classes.join(found, F.col("class_id") == F.col("node"), "left").select("key1", "key2", "n", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    labelled = labelled.withColumnRenamed("n", "_n")
    same = (named["key1"] == labelled["key1"]) & (named["key2"] == labelled["key2"]) & (named["n"] == labelled["_n"]) & named["doc_id"].isNotNull()
    return named.join(labelled, same, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns: of each component those of the least id, and all rows of null id.

    Rows that share an id are one document and stay or go together. Of such rows
    with equal texts one stays, the least as JSON.
    """
    found = settle(classes_and_links(docs, id_col, text_col, size, percent).select("doc_id", "component_id"), "components")
    gone, rows, twice = unused(docs, "gone", "rows", "twice")
    # written, so that its size is known and decides how it is joined
    removed = settle(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "removed")
    docs_id = F.col(f"`{id_col}`").cast("long")
    kept = docs.join(removed, docs_id == F.col(gone), "left_anti")
    repeated = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(twice))
    if repeated.isEmpty():
        return kept
    single, many = (kept.join(repeated, docs_id == F.col(twice), how) for how in ("left_anti", "left_semi"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = many.groupBy(docs_id, F.col(f"`{text_col}`")).agg(F.min_by(row, F.to_json(row)).alias(rows))
    return single.unionByName(least.select(f"{rows}.*"))
