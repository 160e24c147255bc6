"""Raw files, typing, Parquet tables and caches, over files Spark writes from the driver tables."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from sentrace.operators import metrics as M
from sentrace.operators import profile
from sentrace.plans import adapters as A
from sentrace.plans.base import stored, union_all, version, with_views
from sentrace.sources import logs, tables, truth
from sentrace.storage import scratch_path

RAW_TIME = "MM/dd/yyyy HH:mm:ss"
_RAW_LOGS = ("logon", "device", "http", "email", "file")
_NUMBERS = {"email": ["size", "attachments"]}
_raw: dict[tuple[str, str, str], str] = {}


def raw_folder(s, d) -> str:
    """A folder of raw CSV logs and directory snapshots, written once per application and version of its inputs."""
    key = (s.sparkContext.applicationId, d, version(s, d))
    if key in _raw:
        return _raw[key]
    root = scratch_path(s, "raw")
    blank = {"content": "concat('say \"hi\", ', id)", "pc": "'PC-0'"}
    mail = {"content": "concat('say \"hi\", ', id, if(id % 3 = 0, '\\nbye, \\r\\n\"x\"', ''))"}  # with line breaks
    back = {v: k for k, v in logs.OPERATOR_NAMES.items()}
    for name in ("logon", "device", "http", "email", "file"):
        df = getattr(A, name)(s, d)
        have = {back.get(c, c): f"date_format(date, '{RAW_TIME}')" if c == "date" else c for c in df.columns}
        have |= mail if name == "email" else {}
        texts = [f"{have.get(c) or blank[c]} AS `{c}`" for c in logs.LOG_COLUMNS[name]]
        df.selectExpr(*texts).write.csv(f"{root}/{name}.csv", header=True, escape='"')
    traits = A.traits(s, d).selectExpr("concat('Name ', user_id) AS employee_name", "user_id", "o AS O", "c AS C",
                                       "e AS E", "a AS A", "n AS N")
    traits.write.csv(f"{root}/psychometric.csv", header=True)
    snapshots = A.snapshots(s, d)
    for row in snapshots.select("week").distinct().collect():
        snapshots.where(F.col("week") == row["week"]).drop("week").write.csv(
            f"{root}/LDAP/{row['week']}.csv", header=True
        )
    _raw[key] = root
    return root


def _snapshots(s, d):
    return logs.scan_snapshots(s, f"{raw_folder(s, d)}/LDAP", r"(\d{4}-\d{2}-\d{2})\.csv")


def _log(s, d):
    raw = logs.scan_log(s, f"{raw_folder(s, d)}/email.csv", "email")
    return logs.typed_log(raw, "email").selectExpr(
        "CAST(id AS BIGINT) AS id", "date", "user_id", "to_addr", "cc_addr", "from_addr", "size", "attachments",
        "content",
    )


def _messy(s, d):
    """Event times and values as text in several spellings, some of them unreadable."""
    return A.table(s, d, "events").selectExpr(
        "event_id",
        """CASE event_id % 5 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
            WHEN 1 THEN date_format(ts, 'MM/dd/yyyy HH:mm:ss') WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
            WHEN 3 THEN concat('on ', event_id) END AS date""",
        """CASE event_id % 4 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat(' ', event_id, '.7')
            WHEN 2 THEN concat('x', event_id) END AS size""",
    )


def _ingested(s, d):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return tables.ingest(s, raw_folder(s, d), scratch_path(s, "ingested"))


def _retention(s, d):
    root = raw_folder(s, d)
    names = ("logon", "device", "http", "email", "file")
    raw = union_all(
        [logs.scan_log(s, f"{root}/{n}.csv", n).agg(F.expr("count(*) AS rows")).selectExpr(f"'{n}' AS table", "rows")
         for n in names]
    )
    kept = stored(s, d, "sessions").agg(F.expr("count(*) AS rows")).selectExpr("'logon' AS table", "rows")
    typed = union_all(
        [logs.typed_log(logs.scan_log(s, f"{root}/{n}.csv", n), n).where("date IS NOT NULL")
         .agg(F.expr("count(*) AS rows")).selectExpr(f"'{n}' AS table", "rows") for n in names[1:]]
    )
    return profile.retention(raw, kept.unionByName(typed))


def _partitioned(s, d):
    events = A.device(s, d).withColumn("day", F.to_date("date"))
    return tables.write_tables(events, scratch_path(s, "device"), ["day"], ["user_id", "date"]).selectExpr(
        "id", "date", "user_id", "activity", "CAST(day AS DATE) AS day"
    )


def _malicious(s, d):
    """Ragged event lines of the incident users, written as text and read back."""
    path = scratch_path(s, "r4.2-1")
    who = "concat('U', lpad(CAST(user_id AS STRING), 6, '0'))"
    line = f"""CASE event_id % 3 WHEN 0 THEN concat_ws(',', event_type, event_id, date_format(ts, '{RAW_TIME}'), {who},
            'PC-1', 'x', 'y')
        WHEN 1 THEN concat_ws(',', event_type, event_id, date_format(ts, '{RAW_TIME}'), {who}, 'PC-1')
        ELSE if(event_id % 2 = 0, concat_ws(',', event_type, event_id, 'soon', {who}, 'PC-1'),
            concat_ws(',', event_type, event_id)) END AS value"""
    A.table(s, d, "events").selectExpr(line).write.text(path)
    return truth.malicious_events(s, path).select("user_id", "ts", "event_type")


def _incident_file(s, d):
    path = scratch_path(s, "insiders")
    rows = A.incidents(s, d).selectExpr(
        "if(scenario = 3, '5.1', '4.2') AS dataset",
        "scenario",
        "concat('r4.2-', scenario, '-', user_id, '.csv') AS details",
        "user_id AS user",
        f"date_format(inc_start, '{RAW_TIME}') AS start",
        f"if(scenario = 2, 'open', date_format(inc_end, '{RAW_TIME}')) AS `end`",
    )
    rows.write.csv(path, header=True)
    return truth.incidents(s, path, "4.2")


def _cached(s, d):
    root = scratch_path(s, "cache")
    config = {"source": d, "length": 10, "ratios": [0.7, 0.1]}
    builds = []

    def build():
        builds.append(1)
        return stored(s, d, "features").select("session_id", "user_id", "total_actions")

    tables.prepared_cache(s, config, build, root)
    again = tables.prepared_cache(s, config, build, root)
    return again.withColumn("builds", F.lit(len(builds)))


def _reports(s, d):
    """Daily event reports per type, written by day and merged so that the last one wins."""
    path = scratch_path(s, "reports")
    daily = (
        A.table(s, d, "events")
        .groupBy(F.col("event_type").alias("model"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(F.expr("count(*) AS n"), F.expr("round(avg(value), 6) AS mean_value"))
    )
    daily.write.json(path)
    stored_reports = s.read.schema("model string, day string, n bigint, mean_value double").json(path)
    return M.merge_reports(stored_reports, "day")


QUERIES = {
    "scan_log": _log,
    "coerce_types": lambda s, d: logs.coerce_types(_messy(s, d), ["date"], ["size"]),
    "scan_snapshots": lambda s, d: _snapshots(s, d).select("user_id", "role", "department", "ldap_month", "ldap_date"),
    "write_tables": _partitioned,
    "scan_parquet": lambda s, d: tables.scan_parquet(s, f"{d}/orders.parquet", "orders"),
    "ingest_stats": _ingested,
    "incident_file": _incident_file,
    "malicious_events": _malicious,
    "profile_raw": lambda s, d: union_all(
        [profile.profile_raw(logs.scan_log(s, f"{raw_folder(s, d)}/{n}.csv", n), n, _NUMBERS.get(n, [])) for n in _RAW_LOGS]
    ),
    "profile_raw_bytes": lambda s, d: union_all(
        [profile.file_bytes(s, f"{raw_folder(s, d)}/{n}.csv").selectExpr(f"'{n}' AS table", "size") for n in logs.LOG_COLUMNS]
    ),
    "raw_overview": lambda s, d: profile.raw_overview(
        {n: logs.scan_log(s, f"{raw_folder(s, d)}/{n}.csv", n) for n in logs.LOG_COLUMNS}, _snapshots(s, d)
    ),
    "logons_per_session": lambda s, d: profile.logons_per_session(A.logon(s, d), stored(s, d, "sessions")),
    "retention": _retention,
    "prepared_cache": _cached,
    "merge_reports": _reports,
}

# What the raw files lack, by log and column of the file.
_RAW_NULLS = {"email": {"to": "to_addr IS NULL", "cc": "cc_addr IS NULL", "bcc": "TRUE"}, "http": {"url": "url IS NULL"}}


def _raw_sql(name: str) -> str:
    row = f"SELECT '{name}' AS \"table\", '{{c}}' AS column, '{{m}}' AS metric, CAST({{x}} AS VARCHAR) AS value FROM {name}"
    columns = logs.LOG_COLUMNS[name]
    parts = [row.format(c="", m="rows", x="count(*)"), row.format(c="", m="columns", x=f"max({len(columns)})")]
    for c in columns:
        nulls = f"count(*) FILTER (WHERE {_RAW_NULLS.get(name, {}).get(c, 'FALSE')})"
        parts.append(row.format(c=c, m="nulls", x=nulls))
        parts.append(row.format(c=c, m="null_pct", x=f"round(100.0 * CAST({nulls} AS DOUBLE) / count(*), 4)"))
    parts.append(row.format(c="date", m="first_date", x="min(strftime(date, '%Y-%m-%d'))"))
    parts.append(row.format(c="date", m="last_date", x="max(strftime(date, '%Y-%m-%d'))"))
    for c in _NUMBERS.get(name, []):
        parts += [row.format(c=c, m=m, x=f"round(CAST({m}({c}) AS DOUBLE), 4)") for m in ("min", "max", "avg")]
    return " UNION ALL ".join(parts)


_RAW_COUNT = " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in ("logon", "device", "http", "email", "file")
)

ORACLE = {
    "scan_log": with_views(
        "email",
        body="""SELECT id, date_trunc('second', date) AS date, user_id, to_addr, cc_addr, from_addr, size, attachments,
            concat('say "hi", ', id, CASE WHEN id % 3 = 0 THEN concat(chr(10), 'bye, ', chr(13), chr(10), '"x"') ELSE '' END)
                AS content FROM email""",
    ),
    "coerce_types": """SELECT event_id, CASE WHEN event_id % 5 <= 2 THEN date_trunc('second', ts) END AS date,
        CAST(CASE WHEN event_id % 4 <= 1 THEN event_id ELSE 0 END AS BIGINT) AS size FROM events""",
    "scan_snapshots": with_views(
        "snapshots",
        body="""SELECT user_id, role, department, week AS ldap_month, CAST(week AS TIMESTAMP) AS ldap_date
            FROM snapshots""",
    ),
    "write_tables": with_views("device", body="SELECT *, CAST(date AS DATE) AS day FROM device"),
    "scan_parquet": "SELECT * FROM orders",
    "ingest_stats": with_views(
        "logon",
        "device",
        "http",
        "email",
        "file",
        "traits",
        "snapshots",
        body=_RAW_COUNT + " UNION ALL SELECT 'psychometric', count(*) FROM traits"
        " UNION ALL SELECT 'ldap', count(*) FROM snapshots",
    ),
    "incident_file": with_views(
        "incidents",
        body="""SELECT user_id, scenario, concat('r4.2-', scenario, '-', user_id, '.csv') AS details,
            CASE WHEN scenario = 1 THEN date_trunc('second', inc_start) END AS inc_start,
            CASE WHEN scenario = 1 THEN date_trunc('second', inc_end) END AS inc_end
            FROM incidents WHERE scenario <> 3""",
    ),
    "malicious_events": """SELECT concat('U', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS user_id,
        date_trunc('second', ts) AS ts, event_type FROM events WHERE event_id % 3 <> 2""",
    "profile_raw": with_views(*_RAW_LOGS, body=" UNION ALL ".join(map(_raw_sql, _RAW_LOGS))),
    "retention": with_views(
        "sessions",
        "device",
        "http",
        "email",
        "file",
        body="""SELECT "table", rows AS raw, processed, round(100.0 * CAST(processed AS DOUBLE) / rows, 1) AS pct
            FROM (SELECT 'logon' AS "table", (SELECT count(*) FROM logon) AS rows,
                    (SELECT count(*) FROM sessions) AS processed
                UNION ALL SELECT 'device', count(*), count(*) FROM device
                UNION ALL SELECT 'http', count(*), count(*) FROM http
                UNION ALL SELECT 'email', count(*), count(*) FROM email
                UNION ALL SELECT 'file', count(*), count(*) FROM file)""",
    ),
    "raw_overview": with_views(
        "logon",
        "device",
        "http",
        "email",
        "file",
        "traits",
        "snapshots",
        body=f"""SELECT "table", rows, CAST(CASE "table" WHEN 'logon' THEN 5 WHEN 'device' THEN 5 WHEN 'http' THEN 6
                WHEN 'email' THEN 11 WHEN 'file' THEN 6 ELSE 7 END AS INTEGER) AS columns,
                CAST(NULL AS VARCHAR) AS first_month, CAST(NULL AS VARCHAR) AS last_month
            FROM ({_RAW_COUNT} UNION ALL SELECT 'psychometric', count(*) FROM traits)
            UNION ALL SELECT 'LDAP', count(*), CAST(3 AS INTEGER), min(week), max(week) FROM snapshots""",
    ),
    "logons_per_session": with_views(
        "logon",
        "sessions",
        body="""SELECT logons, sessions, CAST(logons AS DOUBLE) / sessions AS ratio FROM (SELECT
            (SELECT count(*) FROM logon WHERE activity = 'Logon') AS logons, (SELECT count(*) FROM sessions) AS sessions)""",
    ),
    "prepared_cache": with_views(
        "features", body="SELECT session_id, user_id, total_actions, CAST(1 AS INTEGER) AS builds FROM features"
    ),
    "merge_reports": """SELECT event_type AS model, day, n, mean_value FROM (SELECT event_type,
        strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean_value,
        row_number() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y-%m-%d') DESC) AS k
        FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d')) WHERE k = 1""",
}
