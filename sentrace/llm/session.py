"""Session options and small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrace.storage import configure

#: Python workers hold one Arrow batch at a time, so batches are small whatever the text length.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return configure(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that does not occur in ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text): what an operator needs of each row, under fixed names.

    Rows are found again by id and text digest together, so that repeated ids do no harm.
    """
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        digest(text_col).alias("digest"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )


def digest(text_col: str):
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def parts_for(df: DataFrame, per_split: int = 8) -> int:
    """Number of hash parts for per-window data: in proportion to the input splits."""
    return max(16, per_split * df.rdd.getNumPartitions())
