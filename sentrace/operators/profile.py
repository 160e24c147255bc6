"""Reports on tables and session features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrace.functions.columns import text_literal
from sentrace.operators.quantiles import exact_quantiles, unpivot
from sentrace.sources.logs import lenient_time

# Fixed: features of the distribution report.
REPORTED_FEATURES = (
    "duration_minutes",
    "total_actions",
    "http_request_count",
    "email_count",
    "file_copy_count",
    "usb_connect_count",
)
LOG_COLUMNS_OF_INTEREST = {"logon": "activity", "device": "activity", "http": "url", "email": "to_addr", "file": "filename"}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_counts(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """(table, rows) of the named tables, 0 for one that does not exist; without names of all in the catalog."""
    parts = []
    if names is None:
        names = sorted(t.name for t in spark.catalog.listTables())
    if not names:
        return spark.createDataFrame([], "table string, rows bigint")
    for name in names:
        if spark.catalog.tableExists(name):
            parts.append(spark.table(name).agg(F.expr("count(*) AS rows")).selectExpr(f"{text_literal(name)} AS table", "rows"))
        else:
            parts.append(spark.range(1).selectExpr(f"{text_literal(name)} AS table", "0L AS rows"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_sample(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def feature_distribution(features: DataFrame, columns: Sequence[str] = REPORTED_FEATURES) -> DataFrame:
    """Min, mean, median, max, sample deviation and count per feature, in one pass plus the median."""
    long = unpivot(features, columns)
    stats = long.groupBy("feature").agg(
        F.expr("min(value) AS min_val"),
        F.expr("avg(value) AS mean_val"),
        F.expr("max(value) AS max_val"),
        F.expr("stddev_samp(value) AS std_val"),
        F.expr("count(*) AS n"),
    )
    medians = exact_quantiles(long, [0.5]).selectExpr("feature", "quantile AS median_val")
    return stats.join(medians, "feature", "left")


def categorical_distribution(features: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """(value, n, pct of all rows), largest first; ``top_n`` is the length of the report."""
    counts = features.groupBy(F.col(column).cast("string").alias("value")).agg(F.expr("count(*) AS n"))
    total = features.agg(F.expr("count(*)")).scalar()
    shared = counts.withColumn("_total", total).selectExpr(
        "value", "n", "round(CAST(n AS DOUBLE) * 100D / _total, 2) AS pct"
    )
    return shared.orderBy(F.desc("n"), "value").limit(top_n) if top_n else shared


def hourly_pattern(features: DataFrame) -> DataFrame:
    return features.groupBy("start_hour").agg(
        F.expr("count(*) AS session_count"),
        F.expr("avg(total_actions) AS avg_actions"),
        F.expr("avg(duration_minutes) AS avg_duration"),
    )


def anomaly_candidates(
    features: DataFrame,
    *,
    max_files: int = 50,
    max_usb: int = 10,
    max_after_hours_actions: int = 500,
    n: int = 50,
) -> DataFrame:
    """The top ``n`` sessions by file copies among those that break a rule."""
    rule = f"""file_copy_count > {max_files} OR usb_connect_count > {max_usb}
        OR (is_after_hours = 1 AND total_actions > {max_after_hours_actions}) OR user_terminated"""
    return (
        features.where(rule)
        .select(
            "session_id",
            "user_id",
            "role",
            "duration_minutes",
            "total_actions",
            "file_copy_count",
            "usb_connect_count",
            "is_after_hours",
            "user_terminated",
        )
        .orderBy(F.desc("file_copy_count"), "session_id")
        .limit(n)
    )


def profile_nulls(df: DataFrame) -> DataFrame:
    """(column, nulls, pct) from one aggregate over all columns."""
    nulls = [f"count_if({_quoted(c)} IS NULL) AS n{i}" for i, c in enumerate(df.columns)]
    one = df.agg(F.expr("count(*) AS _rows"), *[F.expr(t) for t in nulls])
    pairs = ", ".join(f"{text_literal(c)}, n{i}" for i, c in enumerate(df.columns))
    return one.selectExpr("_rows", f"stack({len(df.columns)}, {pairs}) AS (column, nulls)").selectExpr(
        "column", "nulls", "CASE WHEN _rows = 0 THEN 0D ELSE 100D * nulls / _rows END AS pct"
    )


def profile_table(df: DataFrame, name: str, numeric_limit: int | None = None) -> DataFrame:
    """(table, column, type, metric, value): rows, nulls, and avg/min/max of the numeric columns (all by default)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)][:numeric_limit]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wanted = [("", "", "rows", "count(*)")]
    wanted += [(c, kinds[c], "nulls", f"count_if({_quoted(c)} IS NULL)") for c in df.columns]
    wanted += [(c, kinds[c], m, f"{m}({_quoted(c)})") for c in numeric for m in ("avg", "min", "max")]
    one = df.agg(*[F.expr(f"CAST({text} AS DOUBLE) AS m{i}") for i, (_, _, _, text) in enumerate(wanted)])
    rows = ", ".join(f"{text_literal(c)}, '{kind}', '{metric}', m{i}" for i, (c, kind, metric, _) in enumerate(wanted))
    return one.selectExpr(
        f"{text_literal(name)} AS table", f"stack({len(wanted)}, {rows}) AS (column, type, metric, value)"
    )


def date_column(columns: Sequence[str]) -> str | None:
    """The first column whose name speaks of a date or time."""
    return next((c for c in columns if "date" in c.lower() or "time" in c.lower()), None)


def profile_raw(df: DataFrame, name: str, numeric: Sequence[str] = (), size_bytes: DataFrame | None = None) -> DataFrame:
    """Profile of an all-text scan as (table, column, metric, value), values as text.

    ``size_bytes`` is a one-row frame with the size of the files.
    """
    wanted = [("", "rows", "count(*)"), ("", "columns", str(len(df.columns)))]
    for c in df.columns:
        wanted.append((c, "nulls", f"count_if({_quoted(c)} IS NULL)"))
        wanted.append(
            (c, "null_pct", f"round(100D * count_if({_quoted(c)} IS NULL) / greatest(count(*), 1), 4)")
        )
    dated = date_column(df.columns)
    if dated:
        when = f"date_format({lenient_time(_quoted(dated))}, 'yyyy-MM-dd')"
        wanted += [(dated, "first_date", f"min({when})"), (dated, "last_date", f"max({when})")]
    for c in numeric:
        number = f"try_cast({_quoted(c)} AS DOUBLE)"
        wanted += [(c, m, f"round({m}({number}), 4)") for m in ("min", "max", "avg")]
    one = df.agg(*[F.expr(f"CAST({text} AS STRING) AS m{i}") for i, (_, _, text) in enumerate(wanted)])
    rows = ", ".join(f"{text_literal(c)}, '{metric}', m{i}" for i, (c, metric, _) in enumerate(wanted))
    out = one.selectExpr(f"{text_literal(name)} AS table", f"stack({len(wanted)}, {rows}) AS (column, metric, value)")
    if size_bytes is not None:
        size = size_bytes.toDF("size").selectExpr(
            f"{text_literal(name)} AS table", "'' AS column", "'bytes' AS metric", "CAST(size AS STRING) AS value"
        )
        out = out.unionByName(size)
    return out


def file_bytes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row: total size of the files at ``path``. Only their listing is read."""
    return spark.read.format("binaryFile").load(path).agg(F.expr("coalesce(sum(length), 0) AS size"))


def raw_overview(logs: dict[str, DataFrame], directory: DataFrame | None = None, period: str = "ldap_month") -> DataFrame:
    """(table, rows, columns, first_month, last_month) of raw scans and of the directory folder.

    ``directory`` is the scan of all directory files; its row has the first and last period.
    """
    parts = [
        df.agg(F.expr("count(*) AS rows")).selectExpr(
            f"{text_literal(name)} AS table", "rows", f"{len(df.columns)} AS columns",
            "CAST(NULL AS STRING) AS first_month", "CAST(NULL AS STRING) AS last_month",
        )
        for name, df in logs.items()
    ]
    if directory is not None:
        seen = directory.agg(F.expr("count(*) AS rows"), F.min(period).alias("first_month"), F.max(period).alias("last_month"))
        own = [c for c in directory.columns if c not in (period, "ldap_date")]
        parts.append(seen.selectExpr("'LDAP' AS table", "rows", f"{len(own)} AS columns", "first_month", "last_month"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def logons_per_session(logon: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: logons, sessions, and logons for each session (NULL without sessions)."""
    logons = logon.where("activity = 'Logon'").agg(F.expr("count(*) AS logons"))
    return (
        logons.withColumn("sessions", sessions.agg(F.expr("count(*) AS n")).scalar())
        .selectExpr("logons", "sessions", "CASE WHEN sessions > 0 THEN CAST(logons AS DOUBLE) / sessions END AS ratio")
    )


def validate(tables: dict[str, DataFrame], expected: Sequence[str]) -> DataFrame:
    """(check, table, value, passed): presence, emptiness, duplicate ids, negative durations."""
    parts = []
    for name in expected:
        present = name in tables
        spark = next(iter(tables.values())).sparkSession
        if not present:
            parts.append(
                spark.range(1).selectExpr(
                    "'missing' AS check", f"{text_literal(name)} AS table", "1L AS value", "false AS passed"
                )
            )
    for name, df in tables.items():
        sums = ["count(*) AS rows"]
        checks = [("'empty'", "rows", "rows > 0")]
        if name == "logon":
            sums.append("count(*) - count(DISTINCT id) AS duplicates")
            checks.append(("'duplicate_ids'", "duplicates", "duplicates = 0"))
        if name == "sessions":
            sums.append("count_if(duration_minutes < 0) AS negatives")
            checks.append(("'negative_duration'", "negatives", "negatives = 0"))
        rows = ", ".join(f"{c}, {value}, {passed}" for c, value, passed in checks)
        parts.append(
            df.agg(*[F.expr(s) for s in sums]).selectExpr(
                f"{text_literal(name)} AS table", f"stack({len(checks)}, {rows}) AS (check, value, passed)"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("check", "table", "value", "passed")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, change) with change 'added' or 'removed'."""
    spark = before.sparkSession

    def names(df: DataFrame) -> DataFrame:
        return spark.createDataFrame([(c,) for c in df.columns], "column string")

    added = names(after).exceptAll(names(before)).selectExpr("column", "'added' AS change")
    removed = names(before).exceptAll(names(after)).selectExpr("column", "'removed' AS change")
    return added.unionByName(removed)


def retention(raw_counts: DataFrame, new_counts: DataFrame) -> DataFrame:
    """(table, raw, processed, pct) from two (table, rows) frames; NULL pct for an empty raw table."""
    raw = raw_counts.selectExpr("table", "rows AS raw")
    new = new_counts.selectExpr("table", "rows AS processed")
    return raw.join(new, "table", "full").selectExpr(
        "table",
        "raw",
        "coalesce(processed, 0L) AS processed",
        "CASE WHEN raw > 0 THEN round(100D * coalesce(processed, 0L) / raw, 1) END AS pct",
    )


def user_history(
    features: DataFrame, *, user_id: object | None = None, session_id: object | None = None, current: DataFrame | None = None
) -> DataFrame:
    """All sessions of one user, given directly or through one of its sessions.

    ``current`` (a session not stored yet) is added unless its id is already there.
    """
    if session_id is not None:
        found = features.where(F.col("session_id") == F.lit(session_id)).select("user_id").first()
        if found is None:
            raise ValueError(f"session {session_id!r} not found")
        user_id = found["user_id"]
    rows = features.where(F.col("user_id") == F.lit(user_id))
    if current is not None:
        rows = rows.unionByName(current.join(rows.select("session_id"), "session_id", "left_anti").select(rows.columns))
    return rows


def session_timeline(
    sessions: DataFrame, logs: dict[str, DataFrame], session_id: object, *, buffer: str = "5 MINUTES"
) -> DataFrame:
    """(date, type, info) of the user's events around one session, in time order.

    The session is read first, so user and time range reach every log scan as literals.
    """
    found = sessions.where(F.col("session_id") == F.lit(session_id)).first()
    if found is None:
        raise ValueError(f"session {session_id!r} not found")
    low = F.lit(found["start_time"]).cast("timestamp_ntz") - F.expr(f"INTERVAL {buffer}")
    high = F.lit(found["end_time"]).cast("timestamp_ntz") + F.expr(f"INTERVAL {buffer}")
    parts = [
        log.where((F.col("user_id") == found["user_id"]) & F.col("date").between(low, high)).selectExpr(
            "date", f"{text_literal(name)} AS type", f"{LOG_COLUMNS_OF_INTEREST[name]} AS info"
        )
        for name, log in logs.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("date", "type")
