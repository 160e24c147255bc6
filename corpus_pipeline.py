"""Corpus pipeline: five stages of the text operators, applied one after the other to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrace.llm import catalog, decontamination, language_id, line_dedup, packing, shingle_join
from sentrace.llm.session import prepare, read
from sentrace.storage import materialise


def _narrow(docs: DataFrame) -> DataFrame:
    """Id, text, and all other columns in one, so that no result column of an operator hides one of them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *[F.struct(*others).alias("others")] * bool(others))


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(c if c in ("doc_id", "text") else f"others.`{c}`") for c in docs.columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or that fit no language learned from the documents themselves."""
    models = language_id.fit_languages(docs)
    judged = language_id.identify(_narrow(docs), models)
    return _restored(judged.where("NOT rejected"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of runs of 3 lines, or of ``LONG_CHARS`` characters, out of the texts; every document stays, ``n_chars`` follows its text."""
    out = line_dedup.dedup_lines(_narrow(docs), min_chars=line_dedup.LONG_CHARS)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("others.n_chars"))
    return _restored(out.withColumn("others", F.col("others").withField("n_chars", length)), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates keep the document with the smallest id; texts without words stay."""
    first = shingle_join.near_duplicates(_narrow(docs)).where("is_first")
    once = first.where("repeats = 1 OR n_shingles = 0")
    # Rows that agree in id and text: only these few are shuffled again.
    again = first.where("repeats > 1 AND n_shingles > 0").dropDuplicates(["doc_id", "text"])
    return _restored(once.unionByName(again), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a segment of a benchmark item stands."""
    found = decontamination.find_leaks(_narrow(docs), read(spark, sf_dir, "benchmark"))
    return _restored(found.where(F.size("leaks") == 0), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with their token ids' checksums."""
    out = packing.pack(docs, catalog.tokenizer_path(), with_ids=False)
    return out.withColumnRenamed("id", "doc_id").drop("digest", "ids")


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]
#: SQL cannot express the language models, the alignment or the tokenizer; tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each reads what the one before has written to the shared folder."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(prepare(spark), docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
