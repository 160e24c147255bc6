"""Parquet tables, the ingest job, score sinks, and reuse of prepared data."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sentrace.operators.directory import snapshot_changes, snapshot_latest
from sentrace.sources.logs import LOG_COLUMNS, scan_log, scan_snapshots, typed_log
from sentrace.sources.records import pinned_parts


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def write_tables(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()
) -> DataFrame:
    """Write Parquet and return the stored table.

    With ``partition_by`` rows are first rebalanced on those columns: few files per value,
    yet adaptive execution splits a value that is too big for one task. Sorted files keep
    their min/max statistics tight for lookups.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    if partition_by or sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def scan_parquet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Read a Parquet table; with ``name`` also register (or replace) it as a view."""
    df = spark.read.parquet(path)
    if name:
        df.createOrReplaceTempView(name)
    return df


def write_log(raw: DataFrame, table: str, path: str) -> int:
    """Type one raw log, write it partitioned by day and return its row count."""
    typed = typed_log(raw, table)
    seen = Observation()
    out = typed.observe(seen, F.count(F.lit(1)).alias("rows"))
    if "date" in typed.columns:
        write_tables(out.withColumn("day", F.to_date("date")), path, ["day"], ["user_id", "date"])
    else:
        write_tables(out, path)
    return seen.get["rows"]


def ingest(spark: SparkSession, raw_dir: str, out_dir: str, *, multi_line: bool = True, at_once: int = 4) -> DataFrame:
    """Raw folder to Parquet tables: (table, rows). Missing files are skipped with a warning.

    Quoted line breaks are read as part of their field, and large files are read by many
    tasks; ``multi_line=False`` spares the look for such breaks. ``at_once`` tables are
    written at the same time, so that the tasks of small ones fill what large ones leave idle.
    Rows are counted while they are written. Directory history and its latest rows become
    ``ldap_history`` and ``ldap``.
    """
    jobs: list[Callable[[], tuple[str, int]]] = []
    for table in LOG_COLUMNS:
        source = f"{raw_dir}/{table}.csv"
        if not path_exists(spark, source):
            warnings.warn(f"no raw file for {table}: {source}", stacklevel=2)
            continue
        target = f"{out_dir}/{table}.parquet"
        jobs.append(lambda t=table, a=source, b=target: (t, write_log(scan_log(spark, a, t, multi_line=multi_line), t, b)))
    if path_exists(spark, f"{raw_dir}/LDAP"):
        jobs.append(lambda: ("ldap", _write_directory(spark, f"{raw_dir}/LDAP", out_dir)))
    else:
        warnings.warn(f"no directory snapshots: {raw_dir}/LDAP", stacklevel=2)
    with pinned_parts(spark), ThreadPoolExecutor(at_once) as pool:
        stats = list(pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs))
    return spark.createDataFrame(stats, "table string, rows bigint")


def _write_directory(spark: SparkSession, folder: str, out_dir: str) -> int:
    seen = Observation()
    typed = write_tables(scan_snapshots(spark, folder), f"{out_dir}/ldap_snapshots.parquet")
    history = snapshot_changes(typed).observe(seen, F.count(F.lit(1)).alias("rows"))
    stored = write_tables(history, f"{out_dir}/ldap_history.parquet")
    write_tables(snapshot_latest(stored), f"{out_dir}/ldap.parquet")
    return seen.get["rows"]


def write_scores(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Scores as JSON lines, Parquet or CSV (CSV leaves array columns out)."""
    if fmt == "csv":
        flat = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith("array")]
        df.select(*flat).write.mode("overwrite").csv(path, header=True)
    elif fmt in ("json", "parquet"):
        df.write.mode("overwrite").format(fmt).save(path)
    else:
        raise ValueError("fmt must be json, parquet or csv")


def prepared_cache(
    spark: SparkSession, config: dict, build: Callable[[], DataFrame], root: str
) -> DataFrame:
    """Prepared data kept under a hash of its configuration; built only if not complete there.

    The configuration should name the inputs and their version, so that new inputs get a
    new path.
    """
    digest = hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{root.rstrip('/')}/prepared_{digest}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
