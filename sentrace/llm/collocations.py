"""Phrase collocation mining by Rabin-Karp fingerprints.

1. Every chunk of texts becomes word hashes; prefix polynomials give the fingerprint of every run
   of one or two words inside a piece. A chunk counts its own runs first and keeps for each one a
   pointer: the key of a document that holds it.
2. A shuffle adds up the counts of equal fingerprints. Runs of three words are counted in a second
   pass, and only where both their pairs are frequent: a phrase is never more frequent than its
   parts. What the second pass knows of the frequent pairs is a bitmap of bounded size, so a few
   rare runs pass by coincidence and are dropped when they are counted.
3. Only frequent phrases become text: each is looked up in the document its pointer names. A
   fingerprint is 64 bits of one polynomial, and a second polynomial over other word hashes gives
   32 bits more. Runs with equal fingerprints but different second bits are kept apart, and the
   texts behind their pointers tell them for what they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrace.llm import words as W
from sentrace.llm.session import digest
from sentrace.storage import materialise

#: Characters that end a piece, and those between the words of a piece.
SPLITS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
NO_LANG = "und"
#: Text that is hashed at once; a word takes about 100 bytes of memory per run length.
SLICE_BYTES = 1 << 20
#: The ranking is made in this many parts of a language, then of their best.
RANK_PARTS = 16
#: The bitmap of frequent pairs has at most 2 ** this many bits (4 MB).
MAX_BITMAP_BITS = 25
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_N_BITS = 3  # the lowest bits of a fingerprint tell its number of words (0: all words of a language)
_GRAMS = "fp long, proof int, hits long, doc long"

_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(SPLITS)] = 2
_LETTER = np.where(_KIND == 0, W.mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.uint64(0))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_AT = _powers(0xA24BAED4963EE407, 1 << 12)


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The chunk itself, or a long text cut behind characters that end a piece (no phrase is cut)."""
    at = 0
    while len(data) - at > 2 * size:
        ends = np.flatnonzero(_KIND[data[at : at + size]] == 2)
        if len(ends):
            cut = at + int(ends[-1]) + 1
        else:
            later = np.flatnonzero(_KIND[data[at + size :]] == 2)[:1]
            cut = at + size + int(later[0]) + 1 if len(later) else len(data)
        yield data[at:cut], np.clip(offsets - at, 0, cut - at)
        at = cut
    if at < len(data):
        yield data[at:], np.maximum(offsets - at, 0)


class Runs:
    """Words of one slice and the fingerprints of their runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang_keys: np.ndarray):
        self.data = W.lower(data)
        kind = _KIND[self.data]
        start, end = kind == 0, kind == 0
        start[1:] &= kind[:-1] != 0
        end[:-1] &= kind[1:] != 0
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        start[inner] = kind[inner] == 0
        end[inner - 1] = kind[inner - 1] == 0
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.starts] + self.doc
        self.lang = lang_keys[self.doc]
        n = len(self.starts)
        self._prefix, self._inverse = [], []
        for base, hashes in zip(_BASES, (W.word_hashes(self.data, self.starts, self.ends), self._proofs())):
            self._prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, n))]))
            self._inverse.append(_powers(pow(base, -1, 1 << 64), n))

    def _proofs(self) -> np.ndarray:
        """A second hash of every word, from other letter values."""
        out = np.zeros(len(self.starts), np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.data), 1 << 20)), len(self.starts)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            s = self.starts[a:b] - self.starts[a]
            part = self.data[self.starts[a] : self.ends[b - 1]]
            at = np.arange(len(part)) - np.repeat(s, np.diff(np.append(s, len(part))))
            far = (at // len(_AT)).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
            value = _LETTER[part]
            out[a:b] = np.add.reduceat(np.where(value == 0, np.uint64(0), (value ^ far) * _AT[at % len(_AT)]), s)
        return W.mix(out)

    def grams(self, n: int, mask: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, fingerprint and proof of every run of ``n`` words inside one piece."""
        count = len(self.starts)
        at = np.arange(max(0, count - n + 1))
        at = at[self.piece[at] == self.piece[at + n - 1]]
        fp, proof = ((p[at + n] - p[at]) * inverse[at] for p, inverse in zip(self._prefix, self._inverse))
        fp = tagged(W.mix(fp + self.lang[at]) & np.uint64(mask % (1 << 64)), n)
        return at, fp, (W.mix(proof ^ self.lang[at]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def tagged(fp: np.ndarray, n: int) -> np.ndarray:
    low = np.uint64((1 << _N_BITS) - 1)
    return (fp & ~low) | np.uint64(n)


def _counted(fp: np.ndarray, proof: np.ndarray, doc: np.ndarray, hits: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each run of equal fingerprint and proof, with the least pointer."""
    order = np.argsort(fp, kind="stable")
    fp, proof, doc = fp[order], proof[order], doc[order]
    first = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (proof[1:] != proof[:-1])))
    n = np.diff(np.append(first, len(fp))) if hits is None else np.add.reduceat(hits[order], first)
    least = np.minimum.reduceat(doc, first)
    return pa.RecordBatch.from_arrays(
        [pa.array(fp[first].view(np.int64)), pa.array(proof[first]), pa.array(n.astype(np.int64)), pa.array(least)], ["fp", "proof", "hits", "doc"]
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Runs, np.ndarray]]:
    for table in W.chunks(batches, size=2 * SLICE_BYTES):
        docs = table.column("doc").to_numpy()
        langs = table.column("lang_key").to_numpy().view(np.uint64)
        for data, offsets in slices(*W.buffers(table.column("text").chunk(0))):
            runs = Runs(data, offsets, langs)
            if len(runs.starts):
                yield runs, docs


def _short_runs(mask: int):
    """Counts of all words of a language, of single words and of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, docs in _chunks(batches):
            langs, n = np.unique(runs.lang, return_counts=True)
            yield _counted(tagged(langs, 0), np.zeros(len(langs), np.int32), np.full(len(langs), docs[0]), n)
            for size in (1, 2):
                at, fp, proof = runs.grams(size, mask)
                if len(at):
                    yield _counted(fp, proof, docs[runs.doc[at]])

    return run


def _slot(fp: np.ndarray, bits: int) -> np.ndarray:
    return W.mix(fp.copy()) >> np.uint64(64 - bits)


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """Bits of the fingerprints of ``pairs``; at most 2 ** (MAX_BITMAP_BITS - 6) rows reach the driver."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy().view(np.uint64), bits)
            word, bit = (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bit"])

    found = pairs.select("fp").mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"]
    return out


def _triples(mask: int, bitmap, bits: int):
    """Counts of the runs of three words whose pairs both pass the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = bitmap.value.view(np.uint64)
        for runs, docs in _chunks(batches):
            at, fp, _ = runs.grams(2, mask)
            slot = _slot(fp, bits)
            good = np.zeros(len(runs.starts) + 1, bool)
            good[at] = (on[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            at, fp, proof = runs.grams(3, mask)
            both = good[at] & good[at + 1]
            if both.any():
                yield _counted(fp[both], proof[both], docs[runs.doc[at[both]]])

    return run


def _phrases(mask: int):
    """Text of the wanted runs of each document and the fingerprints of the two parts of every cut."""
    names = ["fp", "proof", "a", "lang", "phrase", "k", "left_fp", "left_proof", "right_fp", "right_proof", "all_fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in W.chunks(batches, size=2 * SLICE_BYTES):
            column = table.column("text").chunk(0)
            for row in range(table.num_rows):
                lang = np.array([table.column("lang_key")[row].as_py()], np.int64).view(np.uint64)
                wanted = table.column("wanted").chunk(0).slice(row, 1).flatten()
                fields = [wanted.field(i).to_numpy() for i in range(3)]
                order = np.argsort(fields[0], kind="stable")
                want_fp, want_proof, want_a = (x[order] for x in fields)
                done = np.zeros(len(want_fp), bool)
                out = []
                for data, offsets in slices(*W.buffers(column.slice(row, 1))):
                    runs = Runs(data, offsets, lang)
                    if len(runs.starts):
                        out += _look_up(runs, mask, want_fp, want_proof, want_a, done)
                if out:
                    columns = [list(x) for x in zip(*out)]
                    columns.insert(3, [table.column("lang")[row].as_py()] * len(out))
                    columns.append([int(tagged(lang, 0).view(np.int64)[0])] * len(out))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def _look_up(runs: Runs, mask: int, want_fp: np.ndarray, want_proof: np.ndarray, want_a: np.ndarray, done: np.ndarray) -> list[tuple]:
    grams, place = {}, {}
    for n in (1, 2, 3):
        at, fp, proof = runs.grams(n, mask)
        grams[n] = (at, fp.view(np.int64), proof)
        place[n] = np.full(len(runs.starts) + 1, -1)
        place[n][at] = np.arange(len(at))
    out = []
    for n in (2, 3):
        at, fp, proof = grams[n]
        for i in np.flatnonzero(np.isin(fp, want_fp)).tolist():
            first = int(np.searchsorted(want_fp, fp[i]))
            for w in range(first, len(want_fp)):
                if want_fp[w] != fp[i]:
                    break
                if want_proof[w] != proof[i] or done[w]:
                    continue
                done[w] = True
                s = int(at[i])
                phrase = " ".join(bytes(runs.data[runs.starts[x] : runs.ends[x]]).decode("utf-8", "replace") for x in range(s, s + n))
                for k in range(1, n):
                    left, right = place[k][s], place[n - k][s + k]
                    out.append(
                        (int(fp[i]), int(proof[i]), int(want_a[w]), phrase, k)
                        + tuple(int(g[j][x]) for g, x in ((grams[k], left), (grams[n - k], right)) for j in (1, 2))
                    )
    return out


def mine_phrases(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 10,
    top: int = 2000,
    cover_percent: int = 50,
    fp_mask: int = -1,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two and three words of each language.

    A-Z are lower-cased; texts are split at ``. , ; : ! ?`` and the ASCII line breaks into pieces,
    and pieces at blanks and tabs into words. A null text is empty and a null language is ``und``.
    Rows that repeat count as often as they stand. A phrase needs ``min_count`` occurrences ``a``
    (overlaps count). Of its cuts into two parts with counts ``l`` and ``r`` the one with the
    lowest ``floor(1000000 a a / (l r))`` is its score (ties: the shorter first part). A pair is
    dropped if it stands in a frequent triple that has ``cover_percent`` of its occurrences or more.
    ``n`` is the number of words of the language. Order: score, then ``a``, both descending, then
    the phrase by its bytes. Without documents or frequent phrases there are no rows. ``fp_mask``
    is for tests: it takes bits from the fingerprints, so that they collide.

    Everything is counted over all texts. Skew: each chunk counts before the shuffle, whose rows
    are single fingerprints, so no phrase or language is gathered in one task; the ranking is
    made in ``RANK_PARTS`` parts of each language before their best are ranked together.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG))
    texts = docs.select(
        F.xxhash64(F.col(f"`{id_col}`"), digest(text_col), lang).alias("doc"),
        lang.alias("lang"),
        F.xxhash64(lang).alias("lang_key"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    ).where("text IS NOT NULL")
    seen = texts.select("doc", "lang_key", "text")
    context = docs.sparkSession.sparkContext

    def frequent(found: DataFrame, name: str) -> DataFrame:
        summed = found.groupBy("fp", "proof").agg(F.sum("hits").alias("hits"), F.min("doc").alias("doc"))
        return materialise(summed.where(F.col("hits") >= min_count), name)

    short = frequent(seen.mapInArrow(_short_runs(fp_mask), _GRAMS), "short-runs")
    words_in = F.col("fp").bitwiseAND((1 << _N_BITS) - 1)
    pairs = short.where(words_in == 2)
    bits = min(MAX_BITMAP_BITS, max(10, int(pairs.count()).bit_length() + 5))
    shared = context.broadcast(_bitmap(pairs, bits))
    long_ = frequent(seen.mapInArrow(_triples(fp_mask, shared, bits), _GRAMS), "long-runs")
    counts = short.unionByName(long_)

    wanted = counts.where(words_in >= 2).groupBy("doc").agg(F.collect_list(F.struct("fp", "proof", F.col("hits").alias("a"))).alias("wanted"))
    found = texts.join(materialise(wanted, "wanted"), "doc").select("lang", "lang_key", "text", "wanted")
    cuts = found.mapInArrow(
        _phrases(fp_mask),
        "fp long, proof int, a long, lang string, phrase string, k int, left_fp long, left_proof int, right_fp long, right_proof int, all_fp long",
    )
    cuts = materialise(cuts, "cuts")
    of = {s: counts.select(F.col("fp").alias(f"{s}_fp"), F.col("proof").alias(f"{s}_proof"), F.col("hits").alias(s[0])) for s in ("left", "right")}
    cuts_ = cuts.join(of["left"], ["left_fp", "left_proof"]).join(of["right"], ["right_fp", "right_proof"])
    big = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {big('a')} * {big('a')}) DIV ({big('l')} * {big('r')})")
    keys = ["fp", "proof", "a", "lang", "phrase", "all_fp"]
    best = cuts_.groupBy(*keys).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    # The parts of two words of every triple, with the triple's count.
    part = lambda s: cuts.where(F.col(f"{s}_fp").bitwiseAND((1 << _N_BITS) - 1) == 2).select(
        F.col(f"{s}_fp").alias("fp"), F.col(f"{s}_proof").alias("proof"), F.col("a").alias("longer")
    )
    inside = part("left").unionByName(part("right")).groupBy("fp", "proof").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["fp", "proof"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    for keys in (["lang", "part"], ["lang"]):  # no task ranks more of a language than the best of its parts
        order = Window.partitionBy(*keys).orderBy(F.desc("c.score"), F.desc("a"), "phrase")
        first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = short.where(words_in == 0).select(F.col("fp").alias("all_fp"), F.col("hits").alias("n"))
    return first.join(totals, "all_fp").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")
