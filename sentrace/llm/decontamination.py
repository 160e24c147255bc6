"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Benchmark items are cut into overlapping segments. A region of a text within ``k`` edits of a
segment of ``m`` characters shares at least ``m + 1 - q (k + 1)`` q-grams with it, and these
lie on at most ``k + 1`` neighbouring diagonals (place in the text less place in the segment).
Diagonals are grouped in bands that overlap by ``k``, so one band has them all. Bands that
reach the bound are aligned with the segment, restricted to the band's diagonals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrace.llm import words as W
from sentrace.llm.language_id import HashArray

Q = 8
SEGMENT, STEP = 64, 32
EDIT_RATE = 0.1
#: Shorter items (in normal form) would also match clean text and are left out.
MIN_CHARS = 24
BAND = 32
_CACHED = 1 << 15
#: Bytes of benchmark text whose index is broadcast at a time; more text means more passes.
BLOCK_BYTES = 8 << 20
_LEAK = "array<struct<item_id: bigint, start: int, end: int, distance: int>>"
_GAP = 1
_tables: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Normal form of each code point: letters and digits in lower case, all else one gap."""
    if not _tables:
        out = np.full(0x110000, _GAP, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 and ord(low) < 0xFFFF else 0xFFFF
        out[0] = 0
        _tables.append(out)
    return _tables[0]


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal characters of all texts (runs of gaps become one), their places in their text, the texts' bounds."""
    joined = "".join("\x00" + ("" if t is None else t.replace("\x00", " ")) for t in texts)
    codes = _table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _GAP) | (codes[:-1] > _GAP)
    places = np.flatnonzero(keep)
    codes = codes[places]
    marks = np.flatnonzero(codes == 0)
    places = places - np.repeat(places[marks] + 1, np.diff(np.append(marks, len(codes))))
    return codes, places, np.append(marks, len(codes))


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on."""
    return W.window_hashes(codes.astype(np.uint64) + np.uint64(1), q)


@dataclass
class BenchmarkIndex:
    items: np.ndarray  # item of each segment
    codes: np.ndarray  # segments x SEGMENT, padded with 0
    lengths: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray  # least number of shared q-grams
    array: HashArray  # distinct q-grams
    first: np.ndarray  # per q-gram (in hash order): where its occurrences begin
    segment: np.ndarray  # of each occurrence
    place: np.ndarray
    q: int


def build_index(items: list[int], texts: list[str | None], *, q: int = Q, rate: float = EDIT_RATE) -> BenchmarkIndex:
    codes, _, bounds = normal(texts)
    rows, owner = [], []
    for item, a, b in zip(items, bounds[:-1] + 1, bounds[1:]):
        while b > a and codes[b - 1] <= _GAP:
            b -= 1
        n = b - a
        if n < MIN_CHARS:
            continue
        starts = [0] if n <= SEGMENT else [*range(0, n - SEGMENT, STEP), n - SEGMENT]
        for s in starts:
            rows.append(codes[a + s : min(a + s + SEGMENT, b)])
            owner.append(item)
    lengths = np.array([len(r) for r in rows], np.int64)
    padded = np.zeros((len(rows), SEGMENT), np.uint16)
    for i, r in enumerate(rows):
        padded[i, : len(r)] = r
    budgets = np.minimum((lengths * rate).astype(np.int64), (lengths - q) // q)
    least = lengths + 1 - q * (budgets + 1)
    keys = [grams(r, q) for r in rows]
    segment = np.repeat(np.arange(len(rows)), [len(k) for k in keys]) if rows else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(k)) for k in keys]) if rows else np.zeros(0, np.int64)
    flat = np.concatenate(keys) if rows else np.zeros(0, np.uint64)
    distinct = np.unique(flat)
    array = HashArray(distinct, 0, hashed=True)
    row_of = np.empty(len(distinct), np.int64)
    row_of[array.order_of] = np.arange(len(distinct))
    where = row_of[np.searchsorted(distinct, flat)] if len(flat) else np.zeros(0, np.int64)
    order = np.argsort(where, kind="stable")
    first = np.searchsorted(where[order], np.arange(len(distinct) + 1))
    return BenchmarkIndex(np.array(owner, np.int64), padded, lengths, budgets, least, array, first, segment[order], place[order], q)


def _expand(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all occurrences of the q-grams ``rows``, and which element of ``rows`` each is of."""
    n = first[rows + 1] - first[rows]
    which = np.repeat(np.arange(len(rows)), n)
    return np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(len(which)), which


def _candidates(index: BenchmarkIndex, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, band) of ``codes`` that share enough q-grams."""
    found = np.empty(max(0, len(codes) - index.q + 1), np.int32)
    for a in range(0, len(found), _CACHED):  # pieces that stay in the processor's cache
        found[a : a + _CACHED] = index.array.find(grams(codes[a : a + _CACHED + index.q - 1], index.q))
    hits = np.flatnonzero(found >= 0)
    if not len(hits):
        return hits, hits
    # A region spans at most SEGMENT + its budget: places around which too few hits lie are left out.
    side = SEGMENT + int(index.budgets.max()) + 1
    dense = np.searchsorted(hits, hits + side) - np.searchsorted(hits, hits - side) >= index.bounds.min()
    hits = hits[dense]
    number, which = _expand(index.first, found[hits])
    segment = index.segment[number]
    diagonal = hits[which] - index.place[number] + 2 * SEGMENT
    band = diagonal // BAND
    key = segment << 40 | band << 7 | index.place[number]
    also = diagonal % BAND < index.budgets[segment]
    key = np.sort(np.concatenate([key, key[also] - (1 << 7)]))
    # A q-gram of the segment counts once in a band, however often the text repeats it.
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]] >> 7
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    key = key[count >= index.bounds[key >> 33]]
    return key >> 33, key & ((1 << 33) - 1)


def align(index: BenchmarkIndex, codes: np.ndarray, segment: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edit distance of each segment to its best region in its band, and that region's bounds.

    All candidates go through one dynamic program, row by row. A cell holds the distance and,
    below it, how early the region starts, so that the least cell names the start as well.
    """
    most = int(index.budgets.max())
    width = BAND + 3 * most + 1
    low = band * BAND - 2 * SEGMENT - most  # first diagonal
    start = np.arange(width)[None, :] + low[:, None]
    far, unit = np.int32(1 << 29), np.int32(1 << 12)
    cost = np.where((start >= 0) & (start <= len(codes)), (width - np.arange(width, dtype=np.int32))[None, :], far).astype(np.int32)
    result, end = np.full(len(segment), far), np.zeros(len(segment), np.int64)
    step = np.arange(width, dtype=np.int32) * unit
    lengths = index.lengths[segment]
    for j in range(1, int(lengths.max()) + 1):
        at = start + j
        ok = (at >= 1) & (at <= len(codes))
        text = codes[np.clip(at - 1, 0, len(codes) - 1)]
        new = cost + np.where(text == index.codes[segment, j - 1][:, None], np.int32(0), unit)
        new[~ok] = far
        new[:, :-1] = np.minimum(new[:, :-1], np.where(start[:, :-1] + j >= 0, cost[:, 1:] + unit, far))
        new = np.minimum.accumulate(new - step, axis=1) + step
        new[(at < 0) | (at > len(codes))] = far
        cost = np.minimum(new, far)
        done = lengths == j
        if done.any():
            best = cost[done].argmin(1)
            result[done] = cost[done, best]
            end[done] = at[done, best]
    begin = width - (result & (unit - 1)) + low
    return np.where(result < far, result >> 12, 1 << 20), begin, end


def leaks_of(index: BenchmarkIndex, texts: list[str | None]) -> list[list[dict]]:
    """For each text the items it leaks, with the bounds of all matching regions and the least distance."""
    out: list[list[dict]] = [[] for _ in texts]
    if not len(index.items):
        return out
    codes, places, bounds = normal(texts)
    segment, band = _candidates(index, codes)
    for step in range(0, len(segment), 4096):
        segments = segment[step : step + 4096]
        distance, begin, end = align(index, codes, segments, band[step : step + 4096])
        for hit in np.flatnonzero(distance <= index.budgets[segments]):
            a, b = int(begin[hit]), int(end[hit]) - 1
            row = int(np.searchsorted(bounds, a, side="right")) - 1
            if b < a or a <= bounds[row] or b >= bounds[row + 1]:
                a = max(a, int(bounds[row]) + 1)
                if b < a or b >= bounds[row + 1]:
                    continue
            out[row].append((int(index.items[segments[hit]]), int(places[a]), int(places[b]) + 1, int(distance[hit])))
    merged = []
    for rows in out:
        by_item: dict[int, dict] = {}
        for item, a, b, d in rows:
            own = by_item.setdefault(item, {"item_id": item, "start": a, "end": b, "distance": d})
            own["start"], own["end"], own["distance"] = min(own["start"], a), max(own["end"], b), min(own["distance"], d)
        merged.append([by_item[i] for i in sorted(by_item)])
    return merged


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``leaks``: benchmark items of which a segment stands in the text.

    Texts are compared in normal form (letters and digits in lower case, everything else one
    gap). A segment has up to ``SEGMENT`` characters and may differ by a tenth of them. Each
    leak has the item, the character bounds of all its matching regions together, and the
    least edit distance of a segment. Null and empty texts leak nothing; items with a null id
    or text, or of under ``MIN_CHARS`` normal characters, take no part; equal items of
    different ids are all reported. A column ``leaks`` of ``docs`` is replaced.

    No row is shuffled: the index of a bounded block of the benchmark is broadcast, and a
    larger benchmark is searched block after block.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("body"))
    items = items.where("item IS NOT NULL AND body IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    leaks = T._parse_datatype_string(_LEAK)
    kept = [c for c in docs.columns if c.lower() != "leaks"]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.array().cast(leaks).alias("leaks"))
    arrow = to_arrow_schema(out.schema)
    context = docs.sparkSession.sparkContext
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "body").collect()
        shared = context.broadcast(build_index([r["item"] for r in part], [r["body"] for r in part]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for table in W.chunks(batches, text_col):
                found = leaks_of(shared.value, table.column(text_col).to_pylist())
                if blocks > 1:
                    found = [old + new for old, new in zip(table.column("leaks").to_pylist(), found)]
                columns = [table.column(n).chunk(0) for n in arrow.names[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow.field("leaks").type)], schema=arrow)

        out = out.mapInArrow(search, out.schema)
    return out
