"""Reports, profiles and point lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrace.functions import columns as C
from sentrace.operators import profile
from sentrace.plans import adapters as A
from sentrace.plans.base import history, stored, union_all, with_views


def _logs(s, d):
    return {name: getattr(A, name)(s, d) for name in ("logon", "device", "http", "email", "file")}


def _longest(s, d):
    """The longest session (ties by id), as the subject of single-session reports."""
    top = stored(s, d, "features").orderBy(F.desc("duration_minutes"), "session_id").select("session_id", "user_id")
    return top.first()


def _categories(s, d):
    rows = stored(s, d, "enriched")
    wanted = {"role": 20, "department": 15, "is_after_hours": None, "user_terminated": None}
    return union_all(
        [
            profile.categorical_distribution(rows, c, n).selectExpr(f"'{c}' AS column", "value", "n", "pct")
            for c, n in wanted.items()
        ]
    )


def _counted(s, d):
    names = []
    for name, df in _logs(s, d).items():
        df.createOrReplaceTempView(f"log_{name}")
        names.append(f"log_{name}")
    return profile.table_counts(s, [*names, "log_absent"])


def _history_with_current(s, d):
    longest = _longest(s, d)
    rows = stored(s, d, "features")
    current = rows.where(F.col("session_id") == longest["session_id"])
    return profile.user_history(rows, session_id=longest["session_id"], current=current).select(
        "session_id", "user_id", "start_time", "total_actions"
    )


_LOG_COLUMNS = {
    "logon": "id date user_id pc activity",
    "device": "id date user_id activity",
    "http": "id date user_id url",
    "email": "id date user_id to_addr cc_addr bcc_addr from_addr size attachments",
    "file": "id date user_id filename",
}

QUERIES = {
    "feature_distribution": lambda s, d: profile.feature_distribution(stored(s, d, "features")).selectExpr(
        "feature",
        "n",
        *[f"round({c}, 6) AS {c}" for c in ("min_val", "mean_val", "median_val", "max_val", "std_val")],
    ),
    "categorical_distribution": _categories,
    "hourly_pattern": lambda s, d: profile.hourly_pattern(stored(s, d, "features")).selectExpr(
        "start_hour",
        "session_count",
        "round(avg_actions, 6) AS avg_actions",
        "round(avg_duration, 6) AS avg_duration",
    ),
    "anomaly_candidates": lambda s, d: profile.anomaly_candidates(
        stored(s, d, "enriched"), max_files=2, max_usb=2, max_after_hours_actions=4
    ),
    "table_counts": _counted,
    "table_sample": lambda s, d: profile.table_sample(A.table(s, d, "events"), ["event_id"], 10),
    "profile_nulls": lambda s, d: union_all(
        [profile.profile_nulls(getattr(A, n)(s, d)).selectExpr(f"'{n}' AS table", "*") for n in _LOG_COLUMNS]
    ),
    "profile_table": lambda s, d: profile.profile_table(A.table(s, d, "lineitem"), "lineitem").selectExpr(
        "table", "column", "metric", "round(value, 6) AS value"
    ),
    "validate": lambda s, d: profile.validate(
        {"logon": A.logon(s, d), "sessions": stored(s, d, "sessions"), "device": A.device(s, d)},
        ["logon", "device", "sessions", "session_features"],
    ),
    "schema_diff": lambda s, d: profile.schema_diff(A.snapshots(s, d), history(s, d)).join(
        profile.profile_nulls(history(s, d)), "column", "left"
    ),
    "user_history": _history_with_current,
    "session_timeline": lambda s, d: profile.session_timeline(
        stored(s, d, "sessions"), _logs(s, d), _longest(s, d)["session_id"]
    ),
    "url_host": lambda s, d: A.http(s, d).selectExpr("id", f"{C.url_host('url')} AS host"),
    "file_kind": lambda s, d: A.file(s, d).selectExpr("id", f"{C.file_kind('filename')} AS kind"),
    "mail_direction": lambda s, d: A.email(s, d).selectExpr(
        "id",
        f"{C.mail_direction('user_id', 'from_addr', 'to_addr', 'cc_addr', 'bcc_addr')} AS direction",
        f"{C.mail_external('to_addr', '@dtaa.com')} AS external",
    ),
    "period_of": lambda s, d: A.table(s, d, "events").selectExpr(
        "event_id", f"{C.period_of('ts')} AS month", f"{C.week_of('ts')} AS week"
    ),
    "clamp_hours": lambda s, d: A.incidents(s, d).selectExpr(
        "user_id",
        "inc_start",
        f"{C.clamp_hours('inc_start', 'inc_end')} AS hours",
        f"{C.clamp_hours('inc_end', 'inc_start')} AS reversed_hours",
    ),
    "pad_array": lambda s, d: A.table(s, d, "events")
    .selectExpr("event_id", f"{C.pad_array('array(value, value + 1)', 4, '0D')} AS padded", f"{C.pad_mask('2', 4)} AS m")
    .selectExpr("event_id", "posexplode(arrays_zip(padded, m)) AS (step, cell)")
    .selectExpr("event_id", "step", "cell.padded AS value", "cell.m AS mask"),
}

_DISTRIBUTION = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM features" for c in profile.REPORTED_FEATURES
)
_LOG_INFO = " UNION ALL ".join(
    f"SELECT date, '{name}' AS type, {info} AS info, user_id FROM {name}"
    for name, info in profile.LOG_COLUMNS_OF_INTEREST.items()
)
_TOP = "(SELECT session_id FROM sessions ORDER BY duration_minutes DESC, session_id LIMIT 1)"


def _category_sql(column: str, value: str, limit: int | None) -> str:
    text = f"""SELECT '{column}' AS column, {value} AS value, count(*) AS n,
        round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM enriched GROUP BY {column}"""
    return f"SELECT * FROM ({text} ORDER BY n DESC, value" + (f" LIMIT {limit})" if limit else ")")


_NUMERIC = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
_OTHER = "l_returnflag l_linestatus l_shipdate".split()


def profile_table_sql(name: str, columns: list[str], numeric: list[str]) -> str:
    parts = [f"SELECT '' AS column, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {name}"]
    parts += [
        f"SELECT '{c}', 'nulls', CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) FROM {name}" for c in columns
    ]
    parts += [
        f"SELECT '{c}', '{m}', round(CAST({m}({c}) AS DOUBLE), 6) FROM {name}"
        for c in numeric
        for m in ("avg", "min", "max")
    ]
    return f"SELECT '{name}' AS \"table\", * FROM (" + " UNION ALL ".join(parts) + ")"


ORACLE = {
    "feature_distribution": with_views(
        "features",
        body=f"""SELECT feature, round(min(v), 6) AS min_val, round(avg(v), 6) AS mean_val,
            round(median(v), 6) AS median_val, round(max(v), 6) AS max_val, round(stddev(v), 6) AS std_val,
            count(*) AS n FROM ({_DISTRIBUTION}) GROUP BY feature""",
    ),
    "categorical_distribution": with_views(
        "enriched",
        body=" UNION ALL ".join(
            [
                _category_sql("role", "role", 20),
                _category_sql("department", "department", 15),
                _category_sql("is_after_hours", "CAST(is_after_hours AS VARCHAR)", None),
                _category_sql("user_terminated", "CAST(user_terminated AS VARCHAR)", None),
            ]
        ),
    ),
    "hourly_pattern": with_views(
        "features",
        body="""SELECT start_hour, count(*) AS session_count, round(avg(total_actions), 6) AS avg_actions,
            round(avg(duration_minutes), 6) AS avg_duration FROM features GROUP BY start_hour""",
    ),
    "anomaly_candidates": with_views(
        "enriched",
        body="""SELECT session_id, user_id, role, duration_minutes, total_actions, file_copy_count,
            usb_connect_count, is_after_hours, user_terminated FROM enriched
            WHERE file_copy_count > 2 OR usb_connect_count > 2 OR (is_after_hours = 1 AND total_actions > 4)
                OR user_terminated
            ORDER BY file_copy_count DESC, session_id LIMIT 50""",
    ),
    "table_counts": with_views(
        "logon",
        "device",
        "http",
        "email",
        "file",
        body=" UNION ALL ".join(
            f"SELECT 'log_{n}' AS \"table\", count(*) AS rows FROM {n}"
            for n in ("logon", "device", "http", "email", "file")
        )
        + " UNION ALL SELECT 'log_absent', CAST(0 AS BIGINT)",
    ),
    "table_sample": "SELECT * FROM events ORDER BY event_id LIMIT 10",
    "profile_nulls": with_views(
        *_LOG_COLUMNS,
        body=" UNION ALL ".join(
            f"""SELECT '{n}' AS "table", '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
            100.0 * CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS pct FROM {n}"""
            for n, columns in _LOG_COLUMNS.items()
            for c in columns.split()
        ),
    ),
    "profile_table": profile_table_sql("lineitem", [*_NUMERIC, *_OTHER], _NUMERIC),
    "validate": with_views(
        "logon",
        "device",
        "sessions",
        body="""SELECT 'missing' AS "check", 'session_features' AS "table", CAST(1 AS BIGINT) AS value,
                FALSE AS passed
            UNION ALL SELECT 'empty', 'logon', count(*), count(*) > 0 FROM logon
            UNION ALL SELECT 'duplicate_ids', 'logon', count(*) - count(DISTINCT id),
                count(*) = count(DISTINCT id) FROM logon
            UNION ALL SELECT 'empty', 'sessions', count(*), count(*) > 0 FROM sessions
            UNION ALL SELECT 'negative_duration', 'sessions', count(*) FILTER (WHERE duration_minutes < 0),
                count(*) FILTER (WHERE duration_minutes < 0) = 0 FROM sessions
            UNION ALL SELECT 'empty', 'device', count(*), count(*) > 0 FROM device""",
    ),
    "schema_diff": with_views(
        "history",
        body=" UNION ALL ".join(
            f"""SELECT '{c}' AS column, 'added' AS change, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
            100.0 * CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS pct FROM history"""
            for c in "prev_role prev_department role_changed dept_changed last_week is_terminated".split()
        ),
    ),
    "user_history": with_views(
        "features",
        body=f"""SELECT session_id, user_id, start_time, total_actions FROM features
            WHERE user_id = (SELECT user_id FROM sessions WHERE session_id = {_TOP})""",
    ),
    "session_timeline": with_views(
        "sessions",
        "logon",
        "device",
        "http",
        "email",
        "file",
        body=f"""SELECT e.date, e.type, e.info FROM ({_LOG_INFO}) e JOIN sessions s ON e.user_id = s.user_id
            AND e.date BETWEEN s.start_time - INTERVAL 5 MINUTE AND s.end_time + INTERVAL 5 MINUTE
            WHERE s.session_id = {_TOP}""",
    ),
    "url_host": with_views(
        "http",
        body="""SELECT id, split_part(replace(replace(url, 'http://', ''), 'https://', ''), '/', 1) AS host
            FROM http""",
    ),
    "file_kind": with_views(
        "file",
        body="""SELECT id, CASE WHEN filename LIKE '%.exe' THEN 'exe' WHEN filename LIKE '%.doc%' THEN 'doc'
            WHEN filename LIKE '%.pdf' THEN 'pdf' WHEN filename LIKE '%.zip' OR filename LIKE '%.rar' THEN 'archive'
            WHEN filename IS NOT NULL THEN 'other' END AS kind FROM file""",
    ),
    "mail_direction": with_views(
        "email",
        body="""SELECT id, CASE WHEN sent AND received THEN 'both' WHEN sent THEN 'sent'
                WHEN received THEN 'received' ELSE 'none' END AS direction, external
            FROM (SELECT id, from_addr LIKE '%' || user_id || '%' AS sent,
                coalesce(to_addr LIKE '%' || user_id || '%', FALSE)
                    OR coalesce(cc_addr LIKE '%' || user_id || '%', FALSE) AS received,
                to_addr NOT LIKE '%@dtaa.com%' AS external FROM email)""",
    ),
    "period_of": """SELECT event_id, strftime(ts, '%Y-%m') AS month,
        strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events""",
    "clamp_hours": with_views(
        "incidents",
        body="""SELECT user_id, inc_start,
            date_diff('microsecond', inc_start, inc_end) / CAST(3.6e9 AS DOUBLE) AS hours,
            CAST(0 AS DOUBLE) AS reversed_hours FROM incidents""",
    ),
    "pad_array": """SELECT event_id, CAST(step AS INTEGER) AS step,
        CASE step WHEN 2 THEN value WHEN 3 THEN value + 1 ELSE 0.0 END AS value,
        CAST(CASE WHEN step >= 2 THEN 1 ELSE 0 END AS INTEGER) AS mask
        FROM events, (SELECT unnest([0, 1, 2, 3]) AS step)""",
}
