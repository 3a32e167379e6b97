"""Operator 1: token ids as length-delimited binary records.

A data file is a sequence of frames, all integers little-endian::

    uint64 length | uint32 masked crc32 of the length | payload | uint32 masked crc32 of the payload

and a payload is ``uint8 has_id | int64 id | uint8 width | ids`` with ids of 2
bytes each for vocabularies up to 65,536 and of 4 bytes otherwise. Beside each
data file lies an index file of (uint64 offset, uint64 length) pairs, so records
can be read in any order. The checksum is masked by rotating it right by 15
bits and adding a constant, so that checksums of data which hold checksums
differ from those stored.

Null text counts as empty; each document then holds the end id alone. Rows come
in ascending id order, null ids first, equal ids in text order. An empty table
gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penumbra.llm.shared import fresh_path, settle
from penumbra.llm.words import LOWER, per_document, slices, split_words

MASK_DELTA = 0xA282EAD8  # fixed value of the masked checksum
FRAME_HEAD, PAYLOAD_HEAD = struct.Struct("<QI"), struct.Struct("<BqB")
#: Bytes of text that are split at a time, and words kept per Python worker.
SLICE_BYTES, CACHE_WORDS = 8 << 20, 1_000_000
#: These never join with a letter before them in one pre-token.
_PUNCTUATION = b".,!?;:|*#$%&"

_tokenizers: dict[int, object] = {}
_caches: dict[int, dict[bytes, bytes]] = {}


def masked_crc(data: bytes) -> int:
    """zlib's crc32 of ``data``, rotated and shifted by a constant."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record with its lengths and checksums."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, offset: int = 0) -> tuple[bytes, int]:
    """The payload at ``offset`` and the offset of the next frame; checks both checksums."""
    length, crc = FRAME_HEAD.unpack_from(data, offset)
    if masked_crc(data[offset : offset + 8]) != crc:
        raise ValueError(f"length at byte {offset} doesn't match its checksum")
    start = offset + FRAME_HEAD.size
    payload = data[start : start + length]
    if len(payload) != length or masked_crc(payload) != struct.unpack_from("<I", data, start + length)[0]:
        raise ValueError(f"record at byte {offset} doesn't match its checksum")
    return payload, start + length + 4


def _tokenizer(json: str):
    """The tokenizer and its word cache, kept by the Python worker between tasks."""
    key = zlib.crc32(json.encode())
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[key], _caches[key] = Tokenizer.from_str(json), {}
    return _tokenizers[key], _caches[key]


def _ids_of_words(tokenizer, cache: dict[bytes, bytes], words: list[bytes], dtype) -> list[bytes]:
    """The ids of each word, from the cache where it knows the word."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
    stems, tails = [], []
    for word in words:
        stem = word.rstrip(_PUNCTUATION)
        if len(stem) == len(word) or not stem or not 97 <= stem[-1] <= 122:
            stems.append(word)
            tails.append(b"")
        else:
            stems.append(stem)
            tails.append(word[len(stem) :])
    new = list({w for w in stems if w not in cache} | {w for w in tails if w and w not in cache})
    for i in range(0, len(new), 50_000):
        part = new[i : i + 50_000]
        coded = tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        for w, e in zip(part, coded, strict=True):
            cache[w] = np.array(e.ids, dtype).tobytes()
    return [cache[s] + cache[t] if t else cache[s] for s, t in zip(stems, tails, strict=True)]


def encode_texts(tokenizer, cache: dict[bytes, bytes], texts: pa.Array, end_id: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each closed by ``end_id``, and the offsets of the documents.

    The tokenizer drops white space and lower-cases, so a text's ids are those
    of its words in turn. A text that may hold a special token is encoded whole.
    """
    words = split_words(texts, LOWER)
    vocab = _ids_of_words(tokenizer, cache, words.vocab.to_pylist(), dtype) + [np.array([end_id], dtype).tobytes()]
    sizes = np.fromiter(map(len, vocab), np.int32, len(vocab)) // dtype().itemsize
    ids = np.frombuffer(b"".join(vocab), dtype)
    starts = (np.cumsum(sizes) - sizes).astype(np.int32)
    codes = np.insert(words.codes, words.offsets[1:], len(vocab) - 1)
    offsets = words.offsets + np.arange(len(words.offsets))
    each = sizes[codes]
    ends = np.cumsum(each, dtype=np.int64)
    where = np.repeat((starts[codes] - (ends - each)).astype(np.int32), each)
    where += np.arange(len(where), dtype=np.int32)
    out, out_offsets = ids[where], np.concatenate([[0], ends])[offsets]
    special = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
    if special.any():
        parts = [out[a:b] for a, b in zip(out_offsets[:-1], out_offsets[1:], strict=True)]
        for d in np.flatnonzero(special):
            whole = tokenizer.encode(texts[d].as_py(), add_special_tokens=False).ids
            parts[d] = np.array([*whole, end_id], dtype)
        out, out_offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return out, out_offsets


def _write(batches: Iterator[pa.RecordBatch], json, folder: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    """Write one partition; gives the row of the manifest."""
    tokenizer, cache = _tokenizer(json.value)
    dtype = np.uint16 if width == 2 else np.uint32
    part = TaskContext.get().partitionId()
    target, folder_path = fs.FileSystem.from_uri(folder)
    target.create_dir(folder_path)
    # an attempt has files of its own; the manifest names those of the attempt that succeeded
    name = f"{folder_path}/part-{part:06d}-{uuid.uuid4().hex}"
    docs = tokens = position = 0
    data = index = None
    for batch in slices(batches, "text", SLICE_BYTES):
        if data is None:
            data, index = target.open_output_stream(f"{name}.rec"), target.open_output_stream(f"{name}.idx")
        ids, offsets = encode_texts(tokenizer, cache, batch.column("text"), end_id, dtype)
        frames, places = [], []
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            record = frame(PAYLOAD_HEAD.pack(doc_id is not None, doc_id or 0, width) + ids[a:b].tobytes())
            frames.append(record)
            places.append((position, len(record)))
            position += len(record)
        data.write(b"".join(frames))
        index.write(np.array(places, "<u8").tobytes())
        docs, tokens = docs + len(frames), tokens + len(ids)
    if data is not None:
        data.close()
        index.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name.removeprefix(folder_path + "/")], "n_docs": [docs], "n_tokens": [tokens], "n_bytes": [position]})


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Encode every whole text and write record files in ascending id order.

    Returns the manifest (part, path, n_docs, n_tokens, n_bytes; one row a file,
    files in order of ``part``) and the folder of the files. The manifest is a
    written table: files of attempts that failed are in none of its rows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        json = file.read()
    width = 2 if Tokenizer.from_str(json).get_vocab_size() <= 65_536 else 4
    folder = fresh_path(spark, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(
        partial(_write, json=spark.sparkContext.broadcast(json), folder=folder, end_id=end_id, width=width),
        "part long, path string, n_docs long, n_tokens long, n_bytes long",
    )
    return settle(manifest, "manifest"), folder


def parse_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The id and the token ids of one record."""
    has_id, doc_id, width = PAYLOAD_HEAD.unpack_from(payload)
    return (doc_id if has_id else None), np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=PAYLOAD_HEAD.size)


def read_some(folder: str, path: str, order: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by number, in any order, through the index."""
    source, folder_path = fs.FileSystem.from_uri(folder)
    with source.open_input_stream(f"{folder_path}/{path}.idx") as index:
        places = np.frombuffer(index.read(), "<u8").reshape(-1, 2)
    with source.open_input_file(f"{folder_path}/{path}.rec") as data:
        return [parse_payload(unframe(data.read_at(int(places[k][1]), int(places[k][0])))[0]) for k in order]


def _read(batches: Iterator[pa.RecordBatch], folder: str, chunk: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Read the files named, in order, a chunk at a time."""
    source, folder_path = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with source.open_input_stream(f"{folder_path}/{path}.rec") as data:
                rest, more = b"", True
                while more:
                    got = data.read(chunk)
                    more, rest, at, rows = bool(got), rest + got, 0, []
                    while len(rest) - at >= FRAME_HEAD.size and len(rest) - at >= 16 + FRAME_HEAD.unpack_from(rest, at)[0]:
                        payload, at = unframe(rest, at)
                        doc_id, ids = parse_payload(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    rest = rest[at:]
                    if rows:
                        columns = zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*rows, strict=True), strict=True)
                        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns})
            if rest:
                raise ValueError(f"{path}: {len(rest)} bytes after the last record")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Read every record back: doc_id, start, n_tokens and ids_crc32 of each."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    files = starts.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(partial(_read, folder=folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
