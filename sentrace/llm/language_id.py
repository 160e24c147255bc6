"""Language identification with interpolated Kneser-Ney character models.

Counting covers every training text: tasks count 4-character sequences per language and Spark
sums the counts. Continuation counts, counts of counts and discounts come from all of them in
Spark, so every sequence of every language is in the model, however many there are. The model
is served in blocks of bounded size: a block has the sequences whose two middle characters lie
in one range, and all contexts and lower orders that these need. Per order it keeps one sorted
array of hashes with a row of probabilities (one per language) beside it. Each block is
broadcast on its own; a text's bits are the sum over the blocks. A text gets the language whose
model gives the lowest cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrace.llm import words as W
from sentrace.storage import materialise

ORDER = 4
#: Rows of the largest table of a block. More distinct sequences make more blocks.
MAX_SEQUENCES = 1_000_000
#: Probabilities (sequences times languages) of a block: many languages make smaller blocks.
MAX_CELLS = 4_000_000
#: A text is rejected if its bits per character exceed the mean of the language's training
#: text by MARGIN and DEVIATIONS standard errors of a text of its length.
MARGIN, DEVIATIONS = 1.0, 6.0
UNKNOWN = "und"
_SPACE, _OTHER = 1, 0xFFFF
_ADDED = "lang_pred string, score double, bits double, rejected boolean"
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Class of each code point: letters of the basic plane their number, others one class, the rest a space."""
    if not _classes:
        table = np.full(0x110000, _SPACE, np.uint16)
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        table[letters] = _OTHER
        basic = np.flatnonzero(letters[:_OTHER])
        table[basic] = basic
        table[0] = 0
        _classes.append(table)
    return _classes[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character classes of all texts, the texts' bounds in them, and the number of letters of each.

    Texts are lower-cased; every run without letters is one space, none at the start. Each
    text is preceded by ``ORDER - 1`` spaces that its bounds leave out.
    """
    lead = "\x00" * (ORDER - 1)
    joined = lead + lead.join("" if t is None else t.lower().replace("\x00", " ") for t in texts)
    codes = _class_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] > _SPACE)
    codes = codes[keep]
    mark = np.flatnonzero(codes == 0)
    starts = mark[ORDER - 2 :: ORDER - 1] + 1
    ends = np.append(mark[ORDER - 1 :: ORDER - 1], len(codes))
    letters = np.append(0, np.cumsum(codes > _SPACE))
    codes[mark] = _SPACE
    return codes, np.stack([starts, ends], 1), letters[ends] - letters[starts]


def _sequences(codes: np.ndarray) -> np.ndarray:
    """At each character, it and the ``ORDER - 1`` before it in one number of 16 bits each."""
    wide = codes.astype(np.uint64)
    out = wide.copy()
    for back in range(1, ORDER):
        out[back:] |= wide[:-back] << np.uint64(16 * back)
    return out


def _inside(bounds: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, bounds[:, 0], 1)
    np.add.at(step, bounds[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def _distinct(values: np.ndarray, codes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences at the chosen places with their counts."""
    present = np.flatnonzero(np.bincount(codes, minlength=2))
    if len(present) ** ORDER > 1 << 24:
        return np.unique(values[chosen], return_counts=True)
    small = np.zeros(1 << 16, np.int64)
    small[present] = np.arange(len(present))
    dense = np.zeros(len(codes), np.int64)
    for back in range(ORDER):
        dense[back:] += small[codes[: len(codes) - back]] * len(present) ** back
    counts = np.bincount(dense[chosen])
    found = np.flatnonzero(counts)
    keys, rest = np.zeros(len(found), np.uint64), found.copy()
    for back in range(ORDER):
        rest, digit = np.divmod(rest, len(present))
        keys |= present[digit].astype(np.uint64) << np.uint64(16 * back)
    return keys, counts[found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "sequence", "n"]
            )

    for table in W.chunks(batches):
        langs = table.column("lang").to_pylist()
        texts = table.column("text").to_pylist()
        for lang in sorted(set(langs)):
            codes, bounds, letters = characters([t for t, own in zip(texts, langs) if own == lang])
            chosen = _inside(bounds[letters > 0], len(codes))
            keys, counts = _distinct(_sequences(codes), codes, chosen)
            if lang in held:
                keys = np.concatenate([held[lang][0], keys])
                counts = np.concatenate([held[lang][1], counts])
                keys, where = np.unique(keys, return_inverse=True)
                counts = np.bincount(where, counts, len(keys)).astype(np.int64)
            held[lang] = keys, counts.astype(np.int64)
        if sum(len(k) for k, _ in held.values()) > 2_000_000:
            yield from rows()
            held = {}
    yield from rows()


def _hash(keys: np.ndarray, order: int) -> np.ndarray:
    return W.mix(keys + np.uint64(order << 60))


class HashArray:
    """Distinct keys in the order of their hashes; the top bits of a hash give where to look."""

    def __init__(self, keys: np.ndarray, order: int, hashed: bool = False):
        self.hashed = hashed
        hashes = keys if hashed else _hash(keys, order)
        self.order_of = np.argsort(hashes)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.hashes = np.append(hashes[self.order_of], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.heads = np.searchsorted(self.hashes[:-1] >> np.uint64(64 - self.bits), np.arange(1 << self.bits)).astype(np.int32)
        self.order = order

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        hashes = keys if self.hashed else _hash(keys, self.order)
        at = self.heads[hashes >> np.uint64(64 - self.bits)]
        open_ = np.flatnonzero(self.hashes[at] < hashes)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.hashes[at[open_]] < hashes[open_]]
        at[(self.hashes[at] != hashes) | (at == len(self.hashes) - 1)] = -1
        return at


@dataclass
class LanguageBlock:
    """Per order 1..ORDER: sequences with log2 probabilities, contexts with log2 weights of the order below."""

    tables: list[tuple[HashArray, np.ndarray]]
    contexts: list[tuple[HashArray, np.ndarray]]
    floor: np.ndarray

    def log_probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Row of log2 probabilities, by language, for each sequence of ``order`` characters."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.floor)))
        keys = keys & np.uint64((1 << 16 * order) - 1)
        array, rows = self.tables[order - 1]
        at = array.find(keys)
        out = rows[at]
        absent = np.flatnonzero(at < 0)
        if len(absent):
            contexts, weights = self.contexts[order - 1]
            out[absent] = weights[contexts.find(keys[absent] >> np.uint64(16))] + self.log_probability(keys[absent], order - 1)
        return out


@dataclass
class LanguageModels:
    """Blocks by place: block ``i`` has the sequences from place ``starts[i]`` up to the next start."""

    langs: list[str]
    starts: np.ndarray
    blocks: list[Broadcast]
    mean: np.ndarray
    deviation: np.ndarray


def _places(sequences: np.ndarray) -> np.ndarray:
    """The third character of each sequence and then its second, which say what block it is in."""
    low = np.uint64(0xFFFF)
    return ((sequences >> np.uint64(16)) & low) << np.uint64(16) | (sequences >> np.uint64(32)) & low


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    out = np.zeros((len(found), values.shape[1]))
    np.add.at(out, where, values)
    return found, out


def build(levels: list[tuple[np.ndarray, np.ndarray]], discounts: list[np.ndarray], floor: np.ndarray) -> tuple[LanguageBlock, np.ndarray]:
    """Block from the counts (one column per language) of each order's sequences, and the bits of the highest order's."""
    below_keys, below = np.zeros(1, np.uint64), 2.0 ** floor[None, :]
    tables, contexts = [], []
    for order, ((keys, level), discount) in enumerate(zip(levels, discounts), 1):
        context, total = _sums(keys >> np.uint64(16), level)
        _, kinds = _sums(keys >> np.uint64(16), (level > 0).astype(float))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        own = np.searchsorted(context, keys >> np.uint64(16))
        lower = below[np.searchsorted(below_keys, keys & np.uint64((1 << 16 * (order - 1)) - 1))]
        share = np.where(total[own] > 0, np.maximum(level - discount, 0) / np.maximum(total[own], 1), 0.0)
        p = share + weight[own] * lower
        array, context_array = HashArray(keys, order), HashArray(context, order)
        tables.append((array, np.log2(p)[array.order_of].astype(np.float32)))
        weights = np.log2(weight)[context_array.order_of].astype(np.float32)
        contexts.append((context_array, np.vstack([weights, np.zeros((1, len(floor)), np.float32)])))
        below_keys, below = keys, p
    return LanguageBlock(tables, contexts, floor), -np.log2(below)


def _block_starts(counted: DataFrame, limit: int) -> list[int]:
    """Places at which blocks of at most ``limit`` rows start; only a single place may have more."""
    starts, held = [0], 0
    third = F.shiftright("place", 16)
    for char, rows in counted.groupBy(third.alias("char")).count().orderBy("char").collect():
        places = [(char << 16, rows)]
        if rows > limit:
            places = counted.where(third == char).groupBy("place").count().orderBy("place").collect()
        for place, n in places:
            if held and held + n > limit:
                starts.append(place)
                held = 0
            held += n
    return starts


def _matrix(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of (sequence, lang, n) rows in order, with one column of counts per language."""
    found = rows.select("sequence", "lang", "n").toPandas()
    sequences, where = np.unique(found["sequence"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    counts = np.zeros((len(sequences), len(langs)))
    counts[where, np.searchsorted(langs, found["lang"].to_numpy(str))] = found["n"]
    return sequences, counts


def fit_languages(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_sequences: int = MAX_SEQUENCES) -> LanguageModels:
    """Models of every language in ``labelled``; rows with a null text or language take no part.

    No sequence is left out: ``max_sequences`` bounds the rows of a block, and so what the driver
    and a Python worker hold at a time (sequences with the same two middle characters stay together).
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(_count, "lang string, sequence long, n long")
    place = F.expr("(shiftrightunsigned(sequence, 16) & 65535) << 16 | shiftrightunsigned(sequence, 32) & 65535")
    counted = counted.groupBy("sequence", "lang").agg(F.sum("n").alias("n")).withColumn("place", place)
    counted = materialise(counted, "language-counts", cluster_by=["place"])
    levels = [counted]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("sequence").bitwiseAND(F.lit((1 << 16 * order) - 1))
        level = levels[0].groupBy(shorter.alias("sequence"), "lang").agg(F.count("*").alias("n"))
        levels.insert(0, materialise(level, "language-continuations", cluster_by=["sequence"]))
    few = [F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")]
    few = [{r["lang"]: r for r in level.groupBy("lang").agg(*few).collect()} for level in levels]
    langs = sorted(few[-1])
    if not langs:
        return LanguageModels([], np.zeros(1, np.uint64), [], np.zeros(0), np.zeros(0))
    discounts = [np.array([r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] else 0.5 for r in map(found.get, langs)]) for found in few]
    single = _matrix(levels[0], langs)
    floor = np.log2(np.full(len(langs), 1.0 / (len(single[0]) + 1)))
    starts = _block_starts(counted, min(max_sequences, max(1, MAX_CELLS // len(langs))))
    blocks, n, mean, squares = [], np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs))
    for lo, hi in zip(starts, [*starts[1:], 1 << 32]):
        sequences, counts = _matrix(counted.where((F.col("place") >= lo) & (F.col("place") < hi)), langs)
        # The pairs of a third character are needed whole, also if its sequences are in several blocks.
        pairs = _matrix(levels[1].where((F.col("sequence") >= lo >> 16 << 16) & (F.col("sequence") < ((hi - 1 >> 16) + 1) << 16)), langs)
        triples = _sums(sequences & np.uint64((1 << 48) - 1), (counts > 0).astype(float))
        block, bits = build([single, pairs, triples, (sequences, counts)], discounts, floor)
        blocks.append(labelled.sparkSession.sparkContext.broadcast(block))
        own = counts.sum(0)
        own_mean = (counts * bits).sum(0) / np.maximum(own, 1)
        both = np.maximum(n + own, 1)
        squares += (counts * (bits - own_mean) ** 2).sum(0) + (own_mean - mean) ** 2 * n * own / both
        mean += (own_mean - mean) * own / both
        n += own
    return LanguageModels(langs, np.array(starts, np.uint64), blocks, mean, np.sqrt(squares / np.maximum(n, 1)))


def cross_entropies(models: LanguageModels, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits per character of each text under each model, its characters and its letters."""
    codes, bounds, letters = characters(texts)
    keys = _sequences(codes)
    total = np.zeros((len(texts), len(models.langs)))
    n = bounds[:, 1] - bounds[:, 0]
    several = len(models.blocks) > 1
    part = np.searchsorted(models.starts, _places(keys), "right") - 1 if several else None
    for number, shared in enumerate(models.blocks):
        at = np.flatnonzero(part == number) if several else np.arange(len(keys))
        for step in range(0, len(at), 1 << 19):
            own = at[step : step + (1 << 19)]
            log_p = shared.value.log_probability(keys[own]).astype(np.float64)
            sums = np.vstack([np.zeros((1, len(models.langs))), np.cumsum(log_p, 0)])
            total -= sums[np.searchsorted(own, bounds[:, 1])] - sums[np.searchsorted(own, bounds[:, 0])]
        if several and getattr(shared, "_path", None):
            vars(shared).pop("_value", None)  # one block in memory at a time; it is read again from the worker's copy
    return total / np.maximum(n, 1)[:, None], n, letters


def _judge(models: LanguageModels, texts: list[str | None]) -> list[pa.Array]:
    if not models.langs:
        n, blank = len(texts), characters(texts)[2] == 0
        return [pa.array([UNKNOWN] * n, pa.string()), pa.array([0.0] * n), pa.nulls(n, pa.float64()), pa.array(blank)]
    bits, n, letters = cross_entropies(models, texts)
    best = bits.argmin(1)  # ties to the first language in order
    low = bits[np.arange(len(texts)), best]
    weight = np.exp2((low[:, None] - bits) * np.minimum(n, 64)[:, None])
    score = 1 / weight.sum(1)
    limit = models.mean[best] + MARGIN + DEVIATIONS * models.deviation[best] / np.sqrt(np.maximum(n, 1))
    blank = letters == 0
    named = np.where(blank, UNKNOWN, np.array(models.langs, object)[best])
    return [
        pa.array(named.tolist(), pa.string()),
        pa.array(np.where(blank, 0.0, score)),
        pa.array(np.where(blank, 0.0, low), mask=blank),
        pa.array(blank | (low > limit)),
    ]


def identify(docs: DataFrame, models: LanguageModels, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``bits`` and ``rejected``.

    ``bits`` is the lowest cross-entropy per character, ``lang_pred`` its language (ties: the
    first name in order), ``score`` the share of that language when the likelihoods of 64
    characters (or of the text, if shorter) are compared. A text without any letter, or null,
    gets ``und``, score 0, bits null and is rejected; a text that fits no model is rejected too.
    Without any model every text is ``und``, and only those without letters are rejected.
    Whole texts are read; equal texts get equal results. Columns of these names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T._parse_datatype_string(_ADDED)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in set(added.names)])
    out = T.StructType([*rows.schema.fields, *added.fields])
    schema = to_arrow_schema(out)
    size = W.CHUNK_BYTES * max(1, min(len(models.blocks), 4))  # fewer turns of the blocks

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.chunks(batches, text_col, size):
            columns = [c.chunk(0) for c in table.columns]
            found = _judge(models, table.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*columns, *found], schema=schema)

    return rows.mapInArrow(apply, out)


def held_out(id_col: str, buckets: int, bucket: int) -> Column:
    """Whether the crc32 of an id, written as text, falls in the bucket that is kept for tests."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % buckets == bucket, F.lit(False))
