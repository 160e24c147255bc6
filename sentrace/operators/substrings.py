"""Which of many words occur in a text, in one pass over the text for each bounded block of words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose automaton a task holds at a time; more words mean more passes.
BLOCK_WORDS = 100_000


def _finder(shared):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in shared.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({w for _, w in automaton.iter(t)}) if isinstance(t, str) else [] for t in texts], dtype=object)

    return F.pandas_udf(find, "array<string>")


def words_inside(df: DataFrame, text: str, words: DataFrame, word: str, out: str, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row of ``df`` for each distinct word that occurs in its ``text``, with the word as ``out``.

    An Aho-Corasick automaton finds all words of a block while it reads a text once, so the work
    is linear in the texts and in what is found. Words are spread over blocks of about
    ``block_words`` by hash; a block reaches the tasks as a broadcast. NULL texts and words
    match nothing; the empty word is in every text.
    """
    distinct = words.select(F.col(word).cast("string").alias(out)).where(f"{out} IS NOT NULL").distinct()
    spark, blocks = df.sparkSession, math.ceil(distinct.count() / block_words)
    empty = df.join(distinct.where(f"{out} = ''"), F.expr(f"{text} IS NOT NULL"))  # one row at most on the right
    found = [empty.select(*df.columns, out)]
    for block in range(blocks):
        rows = distinct.where(f"{out} <> '' AND pmod(xxhash64({out}), {blocks}) = {block}").collect()
        if rows:
            inside = _finder(spark.sparkContext.broadcast([r[out] for r in rows]))
            found.append(df.select(*df.columns, F.explode(inside(F.col(text).cast("string"))).alias(out)))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result
