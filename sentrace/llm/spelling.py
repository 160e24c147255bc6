"""Spelling variant grouping: words one edit apart, by dynamic programming over sorted lists.

1. Spark counts the words of all texts; frequent ones are the vocabulary.
2. A word is cut into pieces of two characters. One edit lies in one piece, so two near words agree
   in all that stands before and behind some piece. Those that do form a list; a list is no longer
   than the fillings of one piece allow, however large the vocabulary is.
3. Each list is sorted and scanned for all its words at once. Rows of the banded edit matrix
   (three cells: one edit never leaves the diagonal by more) belong to ranges of words with a
   common prefix, found by the common prefixes of adjacent words: a row is computed once for the
   whole range, and a range whose cells all exceed one edit is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrace.llm.session import free_name
from sentrace.storage import materialise

#: Fixed values of the query's contract: letters of a run, and which runs lose a character.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_EVERY = 97
PIECE, MOST_PIECES = 2, 16
#: Cells (words times length) that are scanned at once.
BLOCK_CELLS = 2_000_000


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): runs of letters with at least ``min_length`` characters and ``min_count`` occurrences.

    A-Z are lower-cased. With ``h`` the checksum (crc32) of ``<id>:<run>``, a run whose ``h`` is
    divisible by 97 loses the character at ``h`` modulo its length. A null id counts as empty; a
    null text has no words; rows that repeat count as often as they stand.
    """
    run = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.where(F.length("run") >= min_length).withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP_EVERY == 0, less).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def width_of(short: Column) -> Column:
    """Characters of a piece; very long words have wider ones, so that their number stays bounded."""
    return F.greatest(F.lit(PIECE), F.ceil(short / MOST_PIECES).cast("int"))


def _lists(words: DataFrame) -> DataFrame:
    """Sorted lists of the words that agree before and behind one piece.

    ``short`` is the length of the shorter word of a pair, so a word stands in the lists of its
    own length and of one less.
    """
    length = F.length("word")
    sized = words.withColumn("short", F.explode(F.array(length, length - 1)))
    sized = sized.where("short > 0").withColumn("width", width_of(F.col("short")))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("short") - 1) / F.col("width")).cast("int"))))
    start = F.col("piece") * F.col("width")
    rest = F.greatest(F.col("short") - start - F.col("width"), F.lit(0))
    behind = F.substring("word", F.length("word") - rest + 1, rest)
    key = F.xxhash64(F.substring("word", F.lit(1), start), behind)
    keyed = pieces.select("short", "piece", key.alias("key"), F.struct("word", "n").alias("w"))
    lists = keyed.groupBy("short", "piece", "key").agg(F.collect_list("w").alias("words")).where(F.size("words") > 1)
    return lists.select("short", "piece", width_of(F.col("short")).alias("width"), F.sort_array("words").alias("words"))


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of ``a`` and ``b`` (padded with 0)."""
    same = a == b
    return np.where(same.all(1), a.shape[1], (~same).argmax(1))


def scan(codes: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with i < j of all words one edit apart in the same group.

    ``codes`` holds a word per row, padded with 0 by at least three columns and sorted within its group.
    """
    n, wide = codes.shape
    lcp = np.full(n, -1)
    together = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp[together] = common_prefix(codes[together], codes[together - 1])
    ends = np.searchsorted(group, group, side="right")
    query = np.flatnonzero(np.arange(1, n + 1) < ends)
    low, high = query + 1, ends[query]
    below, on, above = np.full(len(query), 2, np.int8), np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
    found_i, found_j = [], []
    for depth in range(wide - 2):
        if not len(query):
            break
        # A range falls into one part for each next character.
        heads = np.flatnonzero(lcp <= depth)
        first, last = np.searchsorted(heads, low, side="right"), np.searchsorted(heads, high)
        parts = last - first + 1
        own = np.repeat(np.arange(len(query)), parts)
        step = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.where(step == 0, low[own], heads[np.minimum(first[own] + step - 1, len(heads) - 1)])
        end = np.where(step == parts[own] - 1, high[own], heads[np.minimum(first[own] + step, len(heads) - 1)])
        q, c = query[own], codes[begin, depth]
        below, on, above = below[own], on[own], above[own]
        over = c == 0  # the word has ended, and the range holds no other
        if over.any():
            gap = lengths[q[over]] - lengths[begin[over]]
            cell = np.select([gap == -1, gap == 0, gap == 1], [below[over], on[over], above[over]], 2)
            found_i.append(q[over][cell == 1])
            found_j.append(begin[over][cell == 1])
            go = ~over
            q, c, begin, end, below, on, above = q[go], c[go], begin[go], end[go], below[go], on[go], above[go]
        new_below = np.minimum(on + 1, below + (c != codes[q, depth - 1])) if depth else (on + 1)
        new_on = np.minimum(np.minimum(on + (c != codes[q, depth]), above + 1), new_below + 1)
        new_above = np.minimum(above + (c != codes[q, depth + 1]), new_on + 1)
        live = np.minimum(np.minimum(new_below, new_on), new_above) <= 1
        query, low, high = q[live], begin[live], end[live]
        below, on, above = (np.minimum(x[live], 2).astype(np.int8) for x in (new_below, new_on, new_above))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of every near pair; a pair counts in one of its lists only, that of its first difference."""
    for batch in batches:
        lists = batch.column(3)
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        texts, n = flat.field(0), flat.field(1).to_numpy()
        raw = texts.cast(pa.large_string())
        bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = bytes(raw.buffers()[2][int(bounds[0]) : int(bounds[-1])])
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
        starts = lead[bounds - bounds[0]]
        lengths = np.diff(starts)
        short, piece, width = (batch.column(k).to_numpy() for k in range(3))
        first = np.append(0, np.cumsum(size))
        order = np.argsort(short, kind="stable")  # lists of about equal length are scanned together
        at = 0
        while at < len(order):
            cells = np.cumsum(size[order[at:]] * (short[order[at:]] + 4))
            upto = at + max(1, int(np.searchsorted(cells, BLOCK_CELLS, side="right")))
            part = order[at:upto]
            at = upto
            rows = np.concatenate([np.arange(first[g], first[g + 1]) for g in part])
            group = np.repeat(part, size[part])
            codes = np.zeros((len(rows), int(lengths[rows].max()) + 3), np.uint32)
            filled = np.arange(codes.shape[1]) < lengths[rows][:, None]
            codes[filled] = points[np.repeat(starts[rows] - (np.cumsum(lengths[rows]) - lengths[rows]), lengths[rows]) + np.arange(int(lengths[rows].sum()))]
            i, j = scan(codes, lengths[rows], np.repeat(np.arange(len(part)), size[part]))
            g = group[i]
            differ = np.minimum(common_prefix(codes[i], codes[j]), short[g] - 1)
            good = (differ // width[g] == piece[g]) & (np.minimum(lengths[rows[i]], lengths[rows[j]]) == short[g])
            a, b = rows[i[good]], rows[j[good]]
            if len(a):
                word, near = np.concatenate([a, b]), np.concatenate([b, a])
                yield pa.RecordBatch.from_arrays([texts.take(pa.array(word)), texts.take(pa.array(near)), pa.array(n[near])], ["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of words one insertion, deletion or replacement apart.

    ``words`` has (word, n) with distinct words that are not empty.
    """
    return _lists(words).mapInArrow(_near, "word string, near string, near_n long")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Every round doubles the steps taken; a chain is no
    longer than the logarithm of the largest count, because each step doubles ``n`` at least."""
    steps = materialise(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps")
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = steps.join(after, "root", "left")
        steps = materialise(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "steps")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")


def group_variants(words: DataFrame, *, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """``words`` with ``form``, ``root``, ``n_near`` and ``form_n``.

    ``words`` has one row for each distinct word and its count; other columns are kept, those named
    like results are replaced. Null and empty words are near no word. The form of a word is its near
    word with the largest count (ties: the smallest by code points) if that count is at least twice
    the word's; else null, as is ``form_n``. The root is reached by following forms to the last.
    """
    added = ("form", "root", "n_near", "form_n")
    kept = [c for c in words.columns if c.lower() not in added]
    plain = words.where(F.length(f"`{word_col}`") > 0).select(F.col(f"`{word_col}`").alias("word"), F.col(f"`{n_col}`").cast("long").alias("n"))
    near = near_words(plain).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    near = materialise(near, "near-words")
    fits = plain.join(near, "word").where(-F.col("best.less") >= 2 * F.col("n")).select("word", F.col("best.near").alias("form"))
    roots = _roots(fits)
    mine = free_name(words, "own_word")
    own = words.select(*[F.col(f"`{c}`") for c in kept]).withColumn(mine, F.col(f"`{word_col}`")).alias("w")
    out = own.join(near.alias("m"), F.col(f"w.{mine}") == F.col("m.word"), "left").join(roots.alias("r"), F.col(f"w.{mine}") == F.col("r.word"), "left")
    formed = F.col("r.word").isNotNull()
    return out.select(
        *[F.col(f"w.`{c}`") for c in kept],
        F.when(formed, F.col("m.best.near")).alias("form"),
        F.coalesce("r.root", f"w.{mine}").alias("root"),
        F.coalesce("m.n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, -F.col("m.best.less")).alias("form_n"),
    )
