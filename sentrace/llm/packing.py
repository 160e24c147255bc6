"""Packing of token sequences along a space-filling curve.

Each document is a hashed bag of words, projected on a few fixed random directions; its place
on the Hilbert curve through that space is its sort key. A range sort brings documents with
similar words together; every sorted partition then streams through the tokenizer and fills
sequences one after the other, cutting documents where a sequence is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrace.llm import words as W
from sentrace.llm.session import digest
from sentrace.storage import materialise

LENGTH = 4096
DIMENSIONS, BITS = 4, 12
END_ID = 2
#: Distinct words whose ids a task remembers.
REMEMBERED = 2_000_000
_PIECE = "id long, digest long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_tokenizers: dict[str, WordIds] = {}


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``grid`` (numbers of ``bits`` bits), up to 62 bits in all.

    Works on the bits from the top: a coordinate's bit swaps or flips the lower bits of the
    first coordinate, then the bits are Gray-decoded and interleaved.
    """
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        lower = (1 << level) - 1
        for i in range(n):
            on = (x[i] >> level & 1) == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(on, lower, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> level & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def vectors(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Mean over the words of each text of pseudo-random directions, times the root of their number."""
    starts, ends, first = W.bounds(data, offsets)
    hashes = W.word_hashes(W.lower(data), starts, ends)
    out = np.zeros((len(offsets) - 1, dimensions))
    for d in range(dimensions):
        part = (hashes >> np.uint64(16 * (d % 4))) & np.uint64(0xFFFF)
        total = np.append(0.0, np.cumsum(part.astype(np.float64) / 32767.5 - 1))
        out[:, d] = total[first[1:]] - total[first[:-1]]
    return out / np.maximum(np.diff(first), 1)[:, None] * 4


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each text; every coordinate is squashed to a fixed range first."""
    scaled = (np.tanh(vectors(data, offsets)) + 1) / 2
    return hilbert_keys(np.minimum((scaled * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class WordIds:
    """Token ids of texts, word by word: the tokenizer drops white space, so words are independent.

    Words are known by a 64-bit hash. ``hashes`` is sorted; the ids of the word at place i are
    ``ids[starts[i] : starts[i] + lengths[i]]``. At most ``REMEMBERED`` words are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words by their sorted hashes."""
        fresh = []
        for step in range(0, len(words), 4096):
            fresh += [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(words[step : step + 4096], add_special_tokens=False)]
        lengths = np.array([len(f) for f in fresh], np.int32)
        starts = (len(self.ids) + np.cumsum(lengths) - lengths).astype(np.int32)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts, self.lengths = np.insert(self.starts, at, starts), np.insert(self.lengths, at, lengths)
        self.ids = np.concatenate([self.ids, *fresh])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin."""
        if b"<|" not in data.tobytes():  # no special token, whose case counts
            data = W.lower(data)
        starts, ends, first = W.bounds(data, offsets)
        distinct, example, place = np.unique(W.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        fresh = np.flatnonzero(np.append(self.hashes, np.uint64(0))[at] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(fresh):
            body = data.tobytes()
            some = example[fresh]
            self.learn(distinct[fresh], [body[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        at = at[place]
        n = self.lengths[at].astype(np.int64)
        before = np.append(0, np.cumsum(n))
        source = np.repeat(self.starts[at] - before[:-1], n) + np.arange(before[-1])
        return self.ids[source], before[first]


def tokenizer(path: str) -> WordIds:
    """One per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def _tail(length: int) -> list[int]:
    """Sequence lengths for what is left at the end of a partition: powers of two need no padding."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _pack(path: str, end_id: int, length: int, with_ids: bool):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(_PIECE))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        number = TaskContext.get().partitionId() << 40
        fill, waiting, held = 0, [], []  # pieces of the open sequence wait: it may be the last

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            rows = [
                (i, d, s, len(t), zlib.crc32(t.astype("<u4").tobytes()), n, q, o, t.astype("<u4").tobytes() if with_ids else None)
                for i, d, s, t, n, q, o in rows
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for table in W.chunks(batches, "text", 2 << 20):
            flat, begin = encode.encode(*W.buffers(table.column("text").chunk(0)))
            keys = zip(table.column("id").to_pylist(), table.column("digest").to_pylist())
            for (i, d), a, b in zip(keys, begin[:-1].tolist(), begin[1:].tolist()):
                ids = np.append(flat[a:b], np.uint16(end_id))
                at = 0
                while at < len(ids):
                    part = ids[at : at + length - fill]
                    waiting.append((i, d, at, part, len(ids), number, fill))
                    at, fill = at + len(part), fill + len(part)
                    if fill == length:
                        held += waiting
                        waiting, fill, number = [], 0, number + 1
            if len(held) > 2000:
                yield emit(held)
                held = []
        for size in _tail(fill):
            room, offset = size, 0
            while room:
                i, d, s, t, n, _, _ = waiting.pop(0)
                held.append((i, d, s, t[:room], n, number, offset))
                if len(t) > room:
                    waiting.insert(0, (i, d, s + room, t[room:], n, 0, 0))
                used = min(room, len(t))
                room, offset = room - used, offset + used
            number += 1
        if held:
            yield emit(held)

    return pieces


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    length: int = LENGTH,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens (a power of two).

    A document is the ids of its text (null: none) and ``end_id``. A row is one piece: ``id``,
    ``start`` in the document's ids, ``length``, ``ids_crc32`` of its ids as little-endian
    unsigned 32-bit numbers, ``doc_tokens`` of the whole document, ``sequence_id``, ``offset``
    in the sequence, and the ``ids``. Each id lies in exactly one piece. Sequences are full but
    at the end of a partition, where the rest is split into powers of two, so nothing is
    padded. Rows of equal keys are in the order of id, text digest; repeated rows are packed
    each. Ids of the sequences are unique, not consecutive. No rows: no pieces.

    Texts and keys are written once, then range-sorted; id and digest break ties of the key,
    so that copies of one document spread over many partitions.
    """
    schema = "id long, digest long, text string, place long"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.chunks(batches):
            column = table.column("text").chunk(0)
            found = curve_keys(*W.buffers(column))
            yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in table.columns], pa.array(found)], ["id", "digest", "text", "place"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), digest(text_col).alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    placed = materialise(rows.mapInArrow(keys, schema), "placed")  # the sort reads its keys twice
    order = ["place", "id", "digest"]
    spread = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(_pack(tokenizer_path, end_id, length, with_ids), _PIECE)
