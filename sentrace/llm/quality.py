"""Quality classifier: votes of the nearest labelled texts in a latent-semantic space.

A text is a vector of hashed byte trigrams and of words that follow themselves (log counts
times inverse document frequency over all documents), projected by a truncated SVD that is fitted on a bounded
sample of labelled texts. The sample's vectors are broadcast; every document is compared with
all of them in blocks, exactly, and its nearest neighbours vote with their cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrace.llm import words as W

#: Bounds of the model: labelled texts, hashed features, latent dimensions, bytes of sample text read at once.
SAMPLE, FEATURES, DIMENSIONS = 4096, 4096, 64
NEIGHBOURS = 15
BLOCK = 512
_PRIMES = np.array([2654435761, 40503, 97], np.uint32)


def trigram_counts(data: np.ndarray, offsets: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Counts of hashed byte trigrams of each text, as float32 rows; last, of words equal to the word before."""
    low = data.astype(np.uint32)
    out = np.zeros((len(offsets) - 1, features), np.float32)
    if len(low) < 3:
        return out
    span = data[offsets[0] : offsets[-1]]
    starts, ends, first = W.bounds(span, offsets - offsets[0])
    hashes = W.word_hashes(span, starts, ends)
    again = np.append(0, np.cumsum(np.append(False, hashes[1:] == hashes[:-1])[: len(hashes)]))
    slot = low[:-2] * _PRIMES[0] + low[1:-1] * (_PRIMES[1] << np.uint32(8)) + low[2:] * (_PRIMES[2] << np.uint32(16))
    slot ^= slot >> np.uint32(15)
    slot *= np.uint32(0x85EBCA6B)
    slot = (slot >> np.uint32(7)) % np.uint32(features - 1)
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if b - a >= 3:
            out[row] = np.bincount(slot[a : b - 2], minlength=features)
    out[:, -1] = np.maximum(again[first[1:]] - again[np.minimum(first[:-1] + 1, first[1:])], 0)
    return out


def _document_frequencies(features: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(features, np.int64), 0
        for table in W.chunks(batches):
            data, offsets = W.buffers(table.column("text").chunk(0))
            n += table.num_rows
            for step in range(0, table.num_rows, BLOCK):
                found += (trigram_counts(data, offsets[step : step + BLOCK + 1], features) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(features + 1)), pa.array(np.append(found, n))], ["slot", "n"])

    return count


def _leading_axes(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors as columns, each divided by its singular value.

    The division gives every latent direction the same weight; without it the language of a
    text outweighs its style. Subspace iteration from a fixed start.
    """
    width = min(dimensions + 16, rows.shape[1])
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, scale, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    scale = np.where(scale > 1e-6 * scale[:1], scale, np.inf)
    return (basis @ (turn.T / scale))[:, :dimensions]


@dataclass
class NeighbourModel:
    weights: np.ndarray  # inverse document frequencies
    axes: np.ndarray  # features x dimensions
    vectors: np.ndarray  # unit vectors of the sample
    labels: np.ndarray  # 0..1
    neighbours: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors; a text without trigrams gives zeros."""
        rows = np.log1p(counts) * self.weights
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        out = (rows / np.where(norm > 0, norm, 1)) @ self.axes
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted mean label of the nearest sample texts (ties: the earlier ones)."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        own = self.project(counts)
        k = min(self.neighbours, len(self.labels))
        cosines = own @ self.vectors.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** 2
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.where(total > 0, vote, self.labels.mean())


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    features: int = FEATURES,
    dimensions: int = DIMENSIONS,
    neighbours: int = NEIGHBOURS,
) -> NeighbourModel:
    """Document frequencies from all of ``docs``; axes and neighbours from labelled documents.

    ``labels`` has an id and a label from 0 to 1. At most ``sample`` labelled documents are
    used, those with the smallest hash of their id, so the choice depends on the rows alone.
    It is made on ids; only then are the texts of the chosen read. Several labels of one id
    are averaged. Rows with a null id, text or label take no part.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    counted = texts.mapInArrow(_document_frequencies(features), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = np.zeros(features + 1)
    for row in counted.collect():  # ``features`` + 1 rows
        found[row["slot"]] = row["n"]
    weights = (np.log((1 + found[-1]) / (1 + found[:-1])) + 0.1).astype(np.float32)
    ids = F.col(f"`{id_col}`").cast("long").alias("id")
    known = labels.select(ids, F.col(f"`{label_col}`").cast("double").alias("label")).where("id IS NOT NULL")
    known = known.groupBy("id").agg(F.avg("label").alias("label")).where("label IS NOT NULL")
    rows = docs.select(ids, F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    ranked = known.join(rows.select("id"), "id", "left_semi").select(F.xxhash64("id").alias("rank"), "id", "label")
    chosen = ranked.orderBy("rank", "id").limit(sample)
    chosen = rows.join(F.broadcast(chosen), "id").orderBy("rank", "text").limit(sample)  # at most ``sample`` rows

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.chunks(batches):
            data, offsets = W.buffers(table.column("text").chunk(0))
            for step in range(0, table.num_rows, BLOCK):
                part = trigram_counts(data, offsets[step : step + BLOCK + 1], features)
                packed = [np.log1p(r).astype(np.float16).tobytes() for r in part]
                own = table.slice(step, BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [own.column("rank").combine_chunks(), pa.array(packed, pa.binary()), own.column("label").combine_chunks()],
                    ["rank", "counts", "label"],
                )

    got = chosen.mapInArrow(vectors, "rank long, counts binary, label double").toPandas().sort_values("rank", kind="stable")
    labels = got["label"].to_numpy(float)
    if not len(labels):
        empty = np.zeros((0, dimensions), np.float32)
        return NeighbourModel(weights, np.zeros((features, dimensions), np.float32), empty, labels, neighbours)
    logs = np.stack([np.frombuffer(c, np.float16) for c in got["counts"]]).astype(np.float32)
    rows_ = logs * weights
    norm = np.linalg.norm(rows_, axis=1, keepdims=True)
    rows_ /= np.where(norm > 0, norm, 1)
    axes = _leading_axes(rows_, dimensions)
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    model = NeighbourModel(weights, np.ascontiguousarray(axes, np.float32), np.zeros(0), labels, neighbours)
    model.vectors = np.ascontiguousarray(model.project(np.expm1(logs)), np.float32)
    return model


def score_quality(docs: DataFrame, model: NeighbourModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Whole texts are read; equal texts get equal scores. A null text counts as empty, and a
    text of under three bytes, which no neighbour resembles, gets the mean label of the
    sample (0.5 if nothing was labelled). Columns of these names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"score", "predicted"}])
    out = T.StructType([*rows.schema.fields, *T._parse_datatype_string("score double, predicted int").fields])
    schema, shared = to_arrow_schema(out), docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.chunks(batches, text_col):
            data, offsets = W.buffers(table.column(text_col).chunk(0))
            score = np.zeros(table.num_rows)
            for step in range(0, table.num_rows, BLOCK):
                own = offsets[step : step + BLOCK + 1]
                score[step : step + BLOCK] = shared.value.score(trigram_counts(data, own, len(shared.value.weights)))
            columns = [c.chunk(0) for c in table.columns]
            added = [pa.array(np.clip(score, 0, 1)), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *added], schema=schema)

    return rows.mapInArrow(apply, out)
