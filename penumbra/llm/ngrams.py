"""Hashed byte n-grams of words, for many words at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Stands before and after each word, so n-grams know where words begin and end.
EDGE = 1
_MULTIPLIER = np.uint32(0x9E3779B1)  # fixed value of multiplicative hashing


def framed(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with an edge before each and after the last; where each word's edge is."""
    _, offset_buffer, data = vocab.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32)[vocab.offset : vocab.offset + len(vocab) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    edges = offsets + np.arange(len(offsets))
    out = np.full(len(raw) + len(vocab) + 1, EDGE, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, len(vocab) + 1), np.diff(offsets))] = raw
    return out, edges


def hashed_ngrams(vocab: pa.Array, sizes: tuple[int, ...], buckets: int):
    """For each size: (bucket of the n-gram that begins at each place, whether it lies in one word, each word's first place).

    An n-gram may take the edges on both sides of its word. Bucket 0 is of
    n-grams that lie in no single word; its weights are to be zero.
    """
    data, edges = framed(vocab)
    if not len(vocab):
        return
    n = len(data) - 1
    word = np.repeat(np.arange(len(vocab), dtype=np.int32), np.diff(edges))
    left = edges[1:][word] - np.arange(n)  # bytes up to the edge behind the word
    wide = np.concatenate([data, np.zeros(max(sizes), np.uint8)]).astype(np.uint32)
    for size in sizes:
        code = np.zeros(n, np.uint32)
        for k in range(size):
            code = (code ^ wide[k : k + n]) * _MULTIPLIER
            code ^= code >> np.uint32(15)
        inside = left >= size - 1
        yield np.where(inside, 1 + code % np.uint32(buckets - 1), 0).astype(np.int32), inside, edges[:-1]
