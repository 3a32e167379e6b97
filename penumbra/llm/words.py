"""Word splitting of Arrow string columns, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cases A-Z; white space (0x20, 0x09-0x0D) separates words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Keeps the case; white space separates words.
AS_IS = bytes(range(256))
#: Lower-cases A-Z; every ASCII character but digits and letters separates words.
LOWER_ALNUM = bytes(
    LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


class Words(NamedTuple):
    """``vocab[codes[offsets[d]:offsets[d + 1]]]`` are the words of document d."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array


def _rewritten(texts: pa.Array, table: bytes) -> pa.Array:
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offset_buffer, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    offsets = np.frombuffer(offset_buffer, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    bytes_ = data.slice(first, last - first).to_pybytes().translate(table)
    return pa.Array.from_buffers(
        pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - first)), pa.py_buffer(bytes_)]
    )


def split_words(texts: pa.Array, table: bytes) -> Words:
    """Words of each text after mapping its bytes by ``table``; null: none."""
    lists = pc.ascii_split_whitespace(_rewritten(texts, table))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.cast(pa.binary()).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return Words(coded.indices.to_numpy(), offsets, coded.dictionary)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets; a document without words has 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
