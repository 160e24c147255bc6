"""Substring dedup: repeated windows of words, counted by Rabin-Karp hash, are cut out.

1. Each map task hashes the windows of a few megabytes of text at a time. Windows that are
   equal within such a chunk are recognised there; each distinct hash goes once, packed with
   others, to the part it belongs to. So a passage in a third of all rows sends one entry
   per chunk.
2. Per part, hashes that came from two places are repeated; the places go back to their chunk.
3. Per chunk, repeated windows merge into maximal runs of words, kept by row.
4. Rows meet their runs in a join, and the words are cut.

A hash has 64 bits, and its part follows from the same bits, so the part tells no windows apart
that the hash does not. Equal hashes are not compared as words: of n windows about n^2 / 2^65
different pairs meet by chance (0.7 for 5e9 windows), and each loses its words in both places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrace.llm import words as W
from sentrace.llm.session import free_name, keyed, parts_for

WIDTH = 35
_SENT = "part int, origin long, hashes binary, places binary, ids binary, id_nulls binary, digests binary, first binary, own binary, own_size long"
_BACK = "origin long, size long, places binary, ids binary, id_nulls binary, digests binary, first binary, own binary, own_size long"
_META = ("ids", "id_nulls", "digests", "first", "own", "own_size")


def _pack(places: np.ndarray) -> bytes:
    """Ascending numbers as gaps of two bytes if they fit, else of four."""
    gaps = np.diff(places, prepend=0)
    return gaps.astype(np.uint16 if len(gaps) and gaps.max() < 1 << 16 else np.uint32).tobytes()


def _unpack(packed: bytes, n: int) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint16 if len(packed) == 2 * n else np.uint32)
    return np.cumsum(gaps, dtype=np.int64)


def _send(width: int, parts: int):
    schema = T._parse_datatype_string(_SENT)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, table in enumerate(W.chunks(batches)):
            column = table.column("text").chunk(0)
            data, offsets = W.buffers(column)
            starts, ends, first = W.bounds(data, offsets)
            hashes = W.window_hashes(W.word_hashes(data, starts, ends), width)
            at = W.whole_windows(first, width)
            hashes = hashes[at]
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            same = ranked[1:] == ranked[:-1]
            new = np.append(True, ~same)[: len(ranked)]
            again = np.append(same, False)[: len(ranked)] | ~new
            own = np.sort(at[order[again]])
            picked = np.sort(order[new])
            part = (W.mix(hashes[picked] + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(parts)).astype(np.int64)
            by_part = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
            origin = (task << 32) + number
            rows = {name: [] for name in arrow.names}
            for p in np.flatnonzero(np.diff(cuts)):
                chosen = picked[by_part[cuts[p] : cuts[p + 1]]]
                rows["part"].append(int(p))
                rows["hashes"].append(hashes[chosen].tobytes())
                rows["places"].append(_pack(at[chosen]))
            n = len(rows["part"])
            ids = table.column("id").chunk(0)
            meta = {
                "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                "id_nulls": np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes(),
                "digests": table.column("digest").chunk(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                "first": first.astype(np.int64).tobytes(),
                "own": _pack(own),
                "own_size": len(own),
            }
            if n or len(own):
                rows["part"].append(int(W.mix(np.array([origin], np.uint64))[0] % np.uint64(parts)))
                rows["hashes"].append(None)
                rows["places"].append(None)
                rows["origin"] = [origin] * (n + 1)
                for name in _META:
                    rows[name] = [None] * n + [meta[name]]
                yield pa.RecordBatch.from_pydict(rows, schema=arrow)

    return windows


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """The places whose hash another row of the part has too, and the chunks' own rows."""
    sent = group[group["hashes"].notna()]
    out = group[group["hashes"].isna()][["origin", "places", *_META]].astype(object)
    if len(sent):
        each = [np.frombuffer(h, np.uint64) for h in sent["hashes"]]
        hashes = np.concatenate(each)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        repeated = np.zeros(len(hashes), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        found, at = [], 0
        for origin, places, own in zip(sent["origin"], sent["places"], each):
            mask = repeated[at : at + len(own)]
            at += len(own)
            if mask.any():
                found.append((origin, int(mask.sum()), _pack(_unpack(places, len(own))[mask])))
        out = pd.concat([out, pd.DataFrame(found, columns=["origin", "size", "places"])], ignore_index=True)
    return out.reindex(columns=["origin", "size", "places", *_META]).astype(object).where(lambda d: d.notna(), None).astype({"origin": "int64"})


def _merge(width: int):
    def runs(group: pd.DataFrame) -> pd.DataFrame:
        meta = group[group["ids"].notna()].iloc[0]
        first = np.frombuffer(meta["first"], np.int64)
        total = int(first[-1])
        step = np.zeros(total + 1, np.int64)
        sent = group[group["places"].notna()]
        for places, size in [(meta["own"], meta["own_size"]), *zip(sent["places"], sent["size"])]:
            at = _unpack(places, int(size))
            np.add.at(step, at, 1)
            np.add.at(step, at + width, -1)
        gone = np.cumsum(step[:-1]) > 0
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        ids, nulls = np.frombuffer(meta["ids"], np.int64), np.frombuffer(meta["id_nulls"], np.uint8)
        digests = np.frombuffer(meta["digests"], np.int64)
        before = np.append(0, np.cumsum(gone))
        rows = []
        for d in np.flatnonzero(before[first[1:]] - before[first[:-1]]):
            lo, hi = first[d], first[d + 1]
            near = edge[np.searchsorted(edge, lo, "right") : np.searchsorted(edge, hi, "left")]
            near = np.concatenate([[lo] * bool(gone[lo]), near, [hi] * bool(gone[hi - 1])]) - lo
            rows.append((None if nulls[d] else ids[d], digests[d], near.astype(np.int32).tobytes()))
        out = pd.DataFrame(rows, columns=["id", "digest", "runs"])
        return out.astype({"id": "Int64", "digest": "int64"})

    return runs


def repeated_runs(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, digest, runs): per row with repeated windows, its maximal runs as pairs of int32 word numbers."""
    rows = keyed(docs, id_col, text_col)
    parts = parts_for(docs)
    sent = rows.mapInArrow(_send(width, parts), _SENT)
    back = sent.groupBy("part").applyInPandas(_count, _BACK)
    found = back.groupBy("origin").applyInPandas(_merge(width), "id long, digest long, runs binary")
    # Rows that agree in id and text have the same runs.
    return found.groupBy("id", "digest").agg(F.min("runs").alias("runs"))


def _cut(schema: pa.Schema, text: str, runs: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            n_words, n_removed, kept = [], [], []
            for body, cut in zip(texts, batch.column(batch.schema.get_field_index(runs)).to_pylist()):
                found = [] if body is None else body.split()
                stay = found
                if cut is not None:
                    edges = np.frombuffer(cut, np.int32).tolist()
                    stay, last = [], 0
                    for a, b in zip(edges[::2], edges[1::2]):
                        stay += found[last:a]
                        last = b
                    stay += found[last:]
                n_words.append(len(found))
                n_removed.append(len(found) - len(stay))
                kept.append(None if body is None else b" ".join(stay))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in schema.names[:-3]]
            added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *added], schema=schema)

    return apply


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words no repeated window covers.

    Words are runs without ASCII white space, unchanged. A window is ``width`` consecutive
    words of one row; it is repeated if the same words start anywhere else, in the same row
    or another (a repeated row counts as another). All copies go, also the first. ``kept``
    joins the remaining words by one space; it is null for a null text (0 words) and empty
    for a text without words. Columns with these three names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    found = repeated_runs(docs, id_col=id_col, text_col=text_col, width=width)
    names = ("n_words", "n_removed", "kept")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    rows = rows.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    mark, runs = free_name(rows, "text_digest"), free_name(rows, "runs")
    joined = rows.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`"))).alias("d").join(
        found.withColumnRenamed("runs", runs).alias("f"),
        F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("f.id")) & (F.col(f"d.{mark}") == F.col("f.digest")),
        "left",
    )
    joined = joined.select(*[F.col(f"d.`{c}`") for c in rows.columns], F.col(f"f.{runs}"))
    out = T.StructType([*rows.schema.fields, *T._parse_datatype_string("n_words long, n_removed long, kept string").fields])
    return joined.mapInArrow(_cut(to_arrow_schema(out), text_col, runs), out)
