"""Line dedup by winnowing: later copies of runs of lines are deleted.

Of every ``min_lines`` consecutive lines the line with the smallest hash is a fingerprint, so two
equal runs of that length always share one. Whole windows are hashed and stored with their
fingerprint. Fingerprints that occur once are a prefilter that drops windows; the others are
grouped by the hashes of the whole window, and each is compared with the earliest one of its group
(nothing is extended line by line). Overlapping later windows make up the maximal repeated run.
With ``min_chars``, shorter runs with that many characters are windows of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrace.llm.session import digest, free_name
from sentrace.storage import materialise

MIN_LINES = 3
#: About ten words: with ``min_chars`` so many, runs under ``MIN_LINES`` lines are found as well.
LONG_CHARS = 60


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` loops over it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _full(lines: Column) -> Column:
    """Numbers of the lines that are not blank."""
    numbered = F.transform(lines, lambda line, i: F.when(F.trim(line) != "", i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _windows(text: Column, width: int, min_chars: int | None) -> Column:
    """For each run of ``width`` lines that are not blank: its start, size, fingerprint line and two hashes.

    With ``min_chars`` also for shorter runs of so many characters. Longer runs are then left
    out if each of their lines has as many, because they follow from their lines.
    """
    full = F.filter(lines_of(text), lambda line: F.trim(line) != "")
    hashed = F.transform(full, lambda line: F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"), F.length(F.trim(line)).alias("chars")))

    def cut(all_lines: Column, n: int) -> Column:
        starts = F.when(F.size(all_lines) >= n, F.sequence(F.lit(1), F.size(all_lines) - n + 1)).otherwise(F.array().cast("array<int>"))
        if min_chars is not None:
            chars = lambda s: F.slice(all_lines, s, n)["chars"]
            if n < width:
                starts = F.filter(starts, lambda s: F.aggregate(chars(s), F.lit(0), lambda x, y: x + y) >= min_chars)
            if n > 1:
                starts = F.filter(starts, lambda s: F.array_min(chars(s)) < min_chars)
        return F.transform(starts, lambda s: window(s, F.slice(all_lines, s, n), n))

    def window(start: Column, part: Column, n: int) -> Column:
        return _let(
            part,
            lambda p: F.struct(
                (start - 1).alias("start"),
                F.lit(n).alias("size"),
                F.array_min(p["a"]).alias("print"),
                (start - 1 + F.array_position(p["a"], F.array_min(p["a"])).cast("int") - 1).alias("print_at"),
                F.xxhash64(p["a"]).alias("a"),
                F.xxhash64(p["b"]).alias("b"),
            ),
        )

    widths = [width] if min_chars is None else range(1, width + 1)
    return _let(hashed, lambda lines: F.concat(*[cut(lines, n) for n in widths]))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, width: int, min_chars: int | None = None) -> DataFrame:
    """(id, digest, start, size) of every window of lines that occurs earlier in (id, digest, start) order."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), digest(text_col).alias("digest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    windows = texts.select("id", "digest", F.explode(_windows(F.col("text"), width, min_chars)).alias("w")).select("id", "digest", "w.*")
    windows = materialise(windows, "line-windows")
    prints = windows.select("id", "digest", "print", "print_at").distinct()
    shared = prints.groupBy("print").count().where("count > 1").select("print")
    possible = windows.join(shared, "print", "left_semi")
    key = ["print", "a", "b", "size"]
    place = F.struct("id", "digest", "start")
    first = possible.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return possible.join(first, key).where(place > F.col("first")).select("id", "digest", "start", "size")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int | None = None) -> DataFrame:
    """``docs`` with repeated runs of lines cut from the text, ``n_lines`` and ``n_removed``.

    A line is removed if it lies in a run of at least ``min_lines`` consecutive lines (blank
    lines are skipped and never removed) that also stands earlier: in a row with a smaller id
    (null first; of equal ids the smaller text digest), or before in the same text. The first
    copy of every run stays. With ``min_chars`` a run may have fewer lines if they have so many
    characters together (without blanks around the lines). Rows stay even if their text becomes empty; a null text stays
    null with 0 lines. Rows that agree in id and text count as one document. Columns named
    ``n_lines`` or ``n_removed`` are replaced, others are kept.

    Per-line rows are narrow; texts move once, in the join with the cuts. Groups of equal
    windows are reduced to their first place before they are joined, so that the work is
    linear in the windows and a hot group is split like any skewed join.
    """
    cuts = repeated_windows(docs, id_col, text_col, min_lines, min_chars)
    cuts = cuts.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "size")).alias("starts"))  # at most min_lines per line of the text
    mark, names = free_name(docs, "text_digest"), ("n_lines", "n_removed")
    kept = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(mark, digest(text_col)).alias("d")
    joined = rows.join(cuts.alias("c"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("c.id")) & (F.col(f"d.{mark}") == F.col("c.digest")), "left")
    text = F.col(f"d.`{text_col}`")
    covered = F.flatten(F.transform("c.starts", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    gone = _let(_full(lines_of(text)), lambda full: F.transform(F.array_distinct(covered), lambda i: F.get(full, i)))

    def stay(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    cut = F.when(F.col("c.starts").isNull(), text).otherwise(_let(lines_of(text), stay))
    return joined.select(
        *[cut.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in kept],
        F.when(text.isNull(), 0).otherwise(F.size(lines_of(text))).alias("n_lines"),
        F.when(F.col("c.starts").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).alias("n_removed"),
    )
