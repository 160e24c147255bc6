"""Vectorised word and window hashes of Arrow text batches (words: runs without ASCII white space)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20
_LOW = np.uint64(0xFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = _powers(0xD1342543DE82EF95, 1 << 16)
WINDOW_BASE = 0xA0761D6478BD642F


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text."""
    word = ~_SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, computed in blocks of bounded size."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), _BLOCK)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        part = data[starts[a] : ends[b - 1]]
        at = np.arange(len(part)) - np.repeat(s, np.diff(np.append(s, len(part))))
        value = _BYTE[part]
        if at.max() > int(_LOW):
            far = at.astype(np.uint64) >> np.uint64(16)
            value = value + far * np.uint64(0x9E3779B97F4A7C15)
            at &= int(_LOW)
        total = np.cumsum(value * _POWER[at])
        before = np.concatenate([np.zeros(1, np.uint64), total])
        out[a:b] = mix(before[e] - before[s] + (e - s).astype(np.uint64))
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp polynomial of every run of ``width`` hashes, by doubling the width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, piece, size = None, 0, 1, hashes, 1
    rest = width
    while rest:
        if rest & 1:  # ``piece`` covers ``size`` hashes; append it behind the ``done`` ones
            term = piece[done : done + n] * np.uint64(power)
            out, power = (term if out is None else out + term), power * pow(WINDOW_BASE, size, 1 << 64) % (1 << 64)
            done += size
        rest >>= 1
        if rest:
            piece = piece[:-size] + piece[size:] * np.uint64(pow(WINDOW_BASE, size, 1 << 64))
            size *= 2
    return mix(out)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Word numbers at which a window of ``width`` words lies inside one text."""
    total = int(first[-1])
    ok = np.ones(total, bool)
    ends = first[1:][first[1:] > first[:-1]]
    for back in range(1, width):
        at = ends - back
        ok[at[at >= 0]] = False
    return np.flatnonzero(ok)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Rows of one task in their order, joined or cut to tables of about ``size`` bytes of text."""
    held, held_bytes = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            lengths = np.diff(buffers(batch.column(batch.schema.get_field_index(text)).slice(at))[1])
            take = max(1 if not held else 0, int(np.searchsorted(np.cumsum(lengths), size - held_bytes, side="right")))
            if take:
                held.append(batch.slice(at, take))
                held_bytes += int(lengths[:take].sum())
                at += take
            if at < batch.num_rows or held_bytes >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
