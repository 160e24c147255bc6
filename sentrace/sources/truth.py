"""Ground truth: incident list and malicious event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrace.sources.logs import lenient_time, read_csv

SCENARIOS = (1, 2, 3)


def incidents(spark: SparkSession, path: str | list[str], release: str = "4.2") -> DataFrame:
    """(user_id, scenario, details, inc_start, inc_end) of one release; bad times are NULL.

    If either time is bad, both are NULL.
    """
    rows = read_csv(spark, path).where(F.col("dataset") == str(release))
    parsed = rows.selectExpr(
        "user AS user_id",
        "try_cast(scenario AS INT) AS scenario",
        "details",
        f"{lenient_time('start')} AS _start",
        f"{lenient_time('`end`')} AS _end",
    )
    good = "_start IS NOT NULL AND _end IS NOT NULL"
    return parsed.selectExpr(
        "user_id",
        "scenario",
        "details",
        f"CASE WHEN {good} THEN _start END AS inc_start",
        f"CASE WHEN {good} THEN _end END AS inc_end",
    )


def malicious_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(user_id, ts, event_type, file) from headerless, ragged files.

    Lines with fewer than five fields and lines with an unreadable time are left out.
    """
    lines = spark.read.text(path).selectExpr("split(trim(value), ',') AS f", "_metadata.file_name AS file")
    return (
        lines.where("size(f) >= 5")
        .selectExpr("f[3] AS user_id", f"{lenient_time('f[2]')} AS ts", "f[0] AS event_type", "file")
        .where("ts IS NOT NULL")
    )


def malicious_event_folders(answers_dir: str, release: str = "4.2") -> list[str]:
    """Folders of the event files of a release, one per scenario."""
    return [f"{answers_dir}/r{release}-{n}" for n in SCENARIOS]
