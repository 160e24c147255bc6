"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks broadcast joins from measured sizes and splits skewed
# join partitions; no operator forces a broadcast of data whose size is unknown.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session, else a
    folder in the session's warehouse. The same on every master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def clean(spark: SparkSession) -> None:
    """Delete what this application has stored so far; frames that read it must not be used again."""
    jvm, path = spark._jvm, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *, cluster_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage in a way that survives executor loss and keeps column pruning
    and filter pushdown for every later reader.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
