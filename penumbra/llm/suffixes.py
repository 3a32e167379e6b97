"""Operator 4: benchmark decontamination by suffix arrays of the training texts.

Words are maximal runs of digits, letters and bytes outside ASCII, with A-Z
lower-cased. A task cuts its documents into shards of bounded text. The suffix
array of a shard sorts all its word positions by their first words, packed into
one key; ranges that a test suffix falls into are sorted further as the search
goes deeper, so order is made only where it is looked at. Every test suffix
that starts a window is binary-searched: the range of positions that share the
window gives all its verbatim occurrences, and each is then extended to its
longest match.

The benchmark is written in blocks of bounded text to the shared folder; tasks
read one block at a time, so memory doesn't grow with the benchmark.

Null texts and texts without words have no words, no hits and no items. Items
without words, or with a null id, have no windows. Repeated items count by
distinct id. An empty benchmark finds nothing. Extra columns are ignored by
``find_matches`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.llm.carry import with_text_columns
from penumbra.llm.shared import fresh_path, unused
from penumbra.llm.words import LOWER_ALNUM, Words, per_document, split_words

#: Bytes of text of one shard, and of one block of the benchmark.
SHARD_BYTES, BLOCK_BYTES = 12 << 20, 16 << 20
WINDOW = 10

ADDED = (
    "n_words long, n_hit long, items array<string>, "
    "longest struct<item_id: string, item_word: long, doc_word: long, n_words: long>, "
    "spans array<struct<first: long, last: long>>"
)


class Block(NamedTuple):
    """Test items; ``items`` are the texts of ids, as words."""

    ids: list[str]
    words: Words


def write_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Write the items in files of about ``BLOCK_BYTES`` of text; their URIs."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = fresh_path(benchmark.sparkSession, "benchmark")
    items.repartition(size // BLOCK_BYTES + 1).write.parquet(folder)
    return [r[0] for r in benchmark.sparkSession.read.schema("item_id string, text string").parquet(folder).select(F.col("_metadata.file_path")).distinct().collect()]


@lru_cache(maxsize=1)
def _block(uri: str) -> Block:
    source, path = fs.FileSystem.from_uri(uri)
    with source.open_input_file(path) as file:
        items = pq.read_table(file, columns=["item_id", "text"])
    return Block(items["item_id"].to_pylist(), split_words(items["text"].combine_chunks() if items.num_rows else pa.array([], pa.string()), LOWER_ALNUM))


class Shard:
    """The lazily refined suffix array of a run of documents."""

    def __init__(self, words: Words):
        n_docs = len(words.offsets) - 1
        self.vocab = words.vocab
        # codes from 1; a 0 closes each document, so no match crosses its end
        self.codes = np.insert(words.codes.astype(np.int64) + 1, words.offsets[1:], 0)
        self.starts = words.offsets + np.arange(n_docs + 1)
        self.bits = max(1, int(len(words.vocab)).bit_length())
        self.depth = max(1, 62 // self.bits)
        self.keys = np.zeros(len(self.codes), np.int64)
        for k in range(self.depth):
            self.keys <<= self.bits
            if k < len(self.codes):
                self.keys[: len(self.codes) - k] |= self.codes[k:]
        self.array = np.argsort(self.keys).astype(np.int64)

    def _key(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        inside = at < len(self.keys)
        out[inside] = self.keys[at[inside]]
        return out

    def packed(self, codes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Keys of ``count`` (at most ``depth``) test words from ``first`` on, followed by zeros."""
        out = np.zeros(len(first), np.int64)
        for k in range(self.depth):
            out <<= self.bits
            inside = k < count
            out[inside] |= codes[first[inside] + k]
        return out

    def _refine(self, low: np.ndarray, high: np.ndarray, depth: int) -> None:
        """Sort the ranges, each of positions that agree in ``depth`` words, by the words after those."""
        _, first = np.unique(low, return_index=True)
        low, sizes = low[first], (high - low)[first]
        if not len(low) or sizes.max() < 2:
            return
        group = np.repeat(np.arange(len(low)), sizes)
        where = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        positions = self.array[where]
        self.array[where] = positions[np.lexsort((self._key(positions + depth), group))]

    def _bisect(self, low: np.ndarray, high: np.ndarray, depth: int, keys: np.ndarray) -> np.ndarray:
        """For each range the first place whose words after ``depth`` have a key of at least ``keys``."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = np.zeros(len(low), bool)
            less[open_] = self._key(self.array[middle[open_]] + depth) < keys[open_]
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def ranges(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the test suffix, low, high): the range of the array whose positions share the first ``length`` words of each suffix that occurs."""
        alive = np.arange(len(first))
        low, high = np.zeros(len(first), np.int64), np.full(len(first), len(self.array), np.int64)
        found_suffix, found_low, found_high, depth = [], [], [], 0
        while len(alive):
            count = np.minimum(length[alive] - depth, self.depth)
            key = self.packed(codes, first[alive] + depth, count)
            beyond = key + (np.int64(1) << (self.bits * (self.depth - count)).astype(np.int64))
            if depth:
                self._refine(low, high, depth)
            # one more step within the whole array is a plain binary search over its keys
            low, high = self._bisect(low, high, depth, key), self._bisect(low, high, depth, beyond)
            some = low < high
            alive, low, high, depth = alive[some], low[some], high[some], depth + self.depth
            done = length[alive] <= depth
            found_suffix.append(alive[done])
            found_low.append(low[done])
            found_high.append(high[done])
            alive, low, high = alive[~done], low[~done], high[~done]
        if not found_suffix:
            return (np.zeros(0, np.int64),) * 3
        # later searches sort inside ranges found before, which keeps each range's set of positions
        return tuple(np.concatenate(x) for x in (found_suffix, found_low, found_high))


def _spread(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers from each ``low`` on, ``sizes`` of them, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)


class Found(NamedTuple):
    """What of a block occurs in a shard: windows (position, length), (document, item) pairs, and matches that no word before makes longer."""

    position: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    item: np.ndarray
    matches: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _search(shard: Shard, block: Block, window: int) -> Found:
    """All windows of the block that occur in the shard, each range of the array looked at once.

    A longest match has no equal word before both its ends, so only such pairs
    of test suffix and position are extended: repetitive text has few of them.
    """
    words = block.words
    known = pc.fill_null(pc.index_in(words.vocab, value_set=shard.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.where(known[words.codes] < 0, -1, known[words.codes] + 1) if len(words.codes) else np.zeros(0, np.int64)
    sizes = np.diff(words.offsets)
    item = np.repeat(np.arange(len(sizes)), sizes)
    first = np.arange(len(codes))
    left = words.offsets[1:][item] - first
    length = np.minimum(sizes[item], window)
    strange = np.concatenate([[0], np.cumsum(codes < 0)])
    starts = left >= length
    starts[starts] = strange[first[starts] + length[starts]] == strange[first[starts]]
    item, first, left, length = item[starts], first[starts], left[starts], length[starts]
    suffix, low, high = shard.ranges(codes, first, length)

    # windows of equal words have one range
    _, one, of = np.unique(np.stack([low, high, length[suffix]], 1), axis=0, return_index=True, return_inverse=True) if len(suffix) else (None, suffix, suffix)
    of = of.ravel()
    held = (high - low)[one]
    position, in_range = shard.array[_spread(low[one], held)], np.repeat(np.arange(len(one)), held)
    doc = np.searchsorted(shard.starts, position, side="right") - 1
    docs_of = np.unique(np.stack([in_range, doc], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
    items_of = np.unique(np.stack([of, item[suffix]], 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
    begin, end = (np.searchsorted(items_of[:, 0], docs_of[:, 0], side=side) for side in ("left", "right"))
    pairs = np.unique(np.stack([np.repeat(docs_of[:, 1], end - begin), items_of[_spread(begin, end - begin), 1]], 1), axis=0) if len(docs_of) else np.zeros((0, 2), np.int64)

    # positions of a range by the word before them; those with the suffix's own are left out
    before = np.where(position > 0, shard.codes[position - 1], 0) if len(position) else position
    wide = np.int64(len(shard.vocab) + 3)
    order = np.argsort(in_range * wide + before, kind="stable")
    keys, position_of = (in_range * wide + before)[order], position[order]
    own = np.where(first[suffix] > words.offsets[item[suffix]], codes[np.maximum(first[suffix] - 1, 0)], -1)
    range_low, range_high = np.searchsorted(keys, of * wide), np.searchsorted(keys, (of + 1) * wide)
    same_low = np.where(own < 0, range_low, np.searchsorted(keys, of * wide + own, side="left"))
    same_high = np.where(own < 0, range_low, np.searchsorted(keys, of * wide + own, side="right"))
    spans = [(range_low, same_low - range_low), (same_high, range_high - same_high)]
    who = np.concatenate([np.repeat(suffix, n) for _, n in spans])
    where = np.concatenate([position_of[_spread(at, n)] for at, n in spans])
    longest, growing = length[who].copy(), np.arange(len(who))
    while len(growing):
        growing = growing[(left[who[growing]] > longest[growing]) & (where[growing] + longest[growing] < len(shard.codes))]
        same = codes[first[who[growing]] + longest[growing]] == shard.codes[where[growing] + longest[growing]]
        growing = growing[same]
        longest[growing] += 1
    return Found(position, length[suffix][one][in_range], pairs[:, 0], pairs[:, 1], (item[who], first[who] - words.offsets[item[who]], where, longest))


def score_texts(texts: pa.Array, blocks: list[str], window: int) -> dict[str, pa.Array]:
    """The columns of ``ADDED`` for the texts of one shard."""
    shard = Shard(split_words(texts, LOWER_ALNUM))
    n_docs, n_codes = len(texts), len(shard.codes)
    edges = np.zeros(n_codes + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n_docs)]
    longest: list[dict | None] = [None] * n_docs
    for uri in blocks:
        block = _block(uri)
        found = _search(shard, block, window)
        np.add.at(edges, found.position, 1)
        np.add.at(edges, found.position + found.length, -1)
        for d, i in zip(found.doc.tolist(), found.item.tolist(), strict=True):
            items[d].add(block.ids[i])
        item, item_word, position, match = found.matches
        doc = np.searchsorted(shard.starts, position, side="right") - 1
        order = np.lexsort((item_word, position, -match, doc))
        best = order[np.concatenate([[True], np.diff(doc[order]) > 0])] if len(order) else order
        for k in best.tolist():
            d, m = int(doc[k]), int(match[k])
            if longest[d] is None or longest[d]["n_words"] < m:
                longest[d] = {"item_id": block.ids[item[k]], "item_word": int(item_word[k]), "doc_word": int(position[k] - shard.starts[d]), "n_words": m}
    hit = np.cumsum(edges[:-1]) > 0
    change = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    doc = np.searchsorted(shard.starts, first, side="right") - 1
    spans: list[list[dict]] = [[] for _ in range(n_docs)]
    for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
        spans[d].append({"first": a - int(shard.starts[d]), "last": b - 1 - int(shard.starts[d])})
    types = {f.name: f.type for f in pa.schema([("longest", pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])}
    return {
        "n_words": pa.array(np.diff(shard.starts) - 1, pa.int64()),
        "n_hit": pa.array(per_document(hit.astype(np.int64), shard.starts), pa.int64()),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        "longest": pa.array(longest, types["longest"]),
        "spans": pa.array(spans, types["spans"]),
    }


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The id of each document with its words, hit words, items found, longest match and hit spans."""
    blocks = write_blocks(benchmark, item_col, item_text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_text_columns(rows, "text", ADDED, partial(score_texts, blocks=blocks, window=window), SHARD_BYTES).drop("text")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of the benchmark."""
    blocks = write_blocks(benchmark, item_col, item_text)
    (name,) = unused(docs, "n_hit")
    scored = with_text_columns(docs, text_col, f"{name} long", partial(_hits, blocks=blocks, window=window, name=name), SHARD_BYTES)
    return scored.filter(F.col(name) == 0).drop(name)


def _hits(texts: pa.Array, blocks: list[str], window: int, name: str) -> dict[str, pa.Array]:
    return {name: score_texts(texts, blocks, window)["n_hit"]}
