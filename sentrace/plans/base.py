"""Stored base tables (sessions, session features) shared by the registered queries."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from sentrace.functions.columns import week_of
from sentrace.operators import directory, sessions
from sentrace.plans import adapters as A
from sentrace.storage import configure, materialise

_stored: dict[tuple[str, str, str, str], DataFrame] = {}


def version(spark: SparkSession, sf_dir: str) -> str:
    """Digest of names, sizes and times of the files that the stored steps are made from."""
    source = spark.read.format("binaryFile").load([f"{sf_dir}/events.parquet", f"{sf_dir}/customer.parquet"])
    files = source.select("path", "length", "modificationTime").collect()  # a few files; their content is not read
    return hashlib.md5(str(sorted(map(tuple, files))).encode()).hexdigest()


def forget() -> None:
    """Let stored steps be made again, for example after their files have been cleaned."""
    _stored.clear()


def build_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(A.logon(spark, sf_dir))


def build_features(spark: SparkSession, sf_dir: str, count_mode: str = "true") -> DataFrame:
    return sessions.session_features(
        stored(spark, sf_dir, "sessions"),
        A.device(spark, sf_dir),
        A.http(spark, sf_dir),
        A.email(spark, sf_dir),
        A.file(spark, sf_dir),
        count_mode=count_mode,
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.snapshot_changes(materialise(A.snapshots(spark, sf_dir), "snapshots"), period="week")


def build_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = directory.enrich_directory(
        stored(spark, sf_dir, "features"),
        history(spark, sf_dir),
        session_period=week_of("start_time"),
        period="week",
    )
    return directory.enrich_traits(known, A.traits(spark, sf_dir))


_BUILDERS = {"sessions": build_sessions, "features": build_features, "enriched": build_enriched}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, written to the shared folder once per application and version of its inputs."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir), name)
    if key not in _stored:
        configure(spark)
        _stored[key] = materialise(_BUILDERS[name](spark, sf_dir), name, cluster_by=["user_id", "start_time"])
    return _stored[key]


def with_views(*names: str, body: str) -> str:
    """SQL text ``body`` after the CTEs of the named views and what they need."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in _NEEDS.get(name, ()):
            need(other)
        ordered.append(name)

    for name in names:
        need(name)
    ctes = [f"{n} AS ({_SQL[n]})" for n in ordered]
    return "WITH " + ",\n".join(ctes) + "\n" + body


_NEEDS = {
    "sessions": ("logon",),
    "session_device": ("sessions", "device"),
    "session_http": ("sessions", "http"),
    "session_email": ("sessions", "email"),
    "session_file": ("sessions", "file"),
    "features": ("session_device", "session_http", "session_email", "session_file"),
    "history": ("snapshots",),
    "latest": ("history",),
    "enriched": ("features", "history", "traits"),
    "labelled": ("enriched", "incidents"),
}

_IN_SESSION = "e.user_id = s.user_id AND e.date >= s.start_time AND e.date < s.end_time"
_TOTAL = "device_event_count + http_request_count + email_count + file_copy_count"


def _big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def count_sql(log: str, columns: dict[str, str]) -> str:
    """Per-session counts by a plain range join, as the check for the Spark operators."""
    selected = ",\n".join(_big(expression, name) for name, expression in columns.items())
    return f"SELECT s.session_id, {selected} FROM sessions s LEFT JOIN {log} e ON {_IN_SESSION} GROUP BY s.session_id"


DEVICE_SQL = {
    "device_event_count": "count(e.id)",
    "usb_connect_count": "count(CASE WHEN e.activity = 'Connect' THEN 1 END)",
    "usb_disconnect_count": "count(CASE WHEN e.activity = 'Disconnect' THEN 1 END)",
}
HTTP_SQL = {
    "http_request_count": "count(e.id)",
    "unique_domains": "count(DISTINCT CASE WHEN e.url IS NOT NULL THEN "
    "split_part(replace(replace(e.url, 'http://', ''), 'https://', ''), '/', 1) END)",
}
EMAIL_SQL = {
    "email_count": "count(e.id)",
    "emails_sent": "count(CASE WHEN e.from_addr LIKE '%' || s.user_id || '%' THEN 1 END)",
    "emails_received": "count(CASE WHEN e.to_addr LIKE '%' || s.user_id || '%' OR e.cc_addr LIKE '%' || s.user_id "
    "|| '%' OR e.bcc_addr LIKE '%' || s.user_id || '%' THEN 1 END)",
    "total_attachments": "coalesce(sum(e.attachments), 0)",
    "total_email_size": "coalesce(sum(e.size), 0)",
    "external_email_count": "count(CASE WHEN e.to_addr NOT LIKE '%@dtaa.com%' THEN 1 END)",
}
FILE_SQL = {
    "file_copy_count": "count(e.id)",
    "exe_copy_count": "count(CASE WHEN e.filename LIKE '%.exe' THEN 1 END)",
    "doc_copy_count": "count(CASE WHEN e.filename LIKE '%.doc%' THEN 1 END)",
    "pdf_copy_count": "count(CASE WHEN e.filename LIKE '%.pdf' THEN 1 END)",
    "archive_copy_count": "count(CASE WHEN e.filename LIKE '%.zip' OR e.filename LIKE '%.rar' THEN 1 END)",
}
ALL_COUNTS = [*DEVICE_SQL, *HTTP_SQL, *EMAIL_SQL, *FILE_SQL]

_SQL = {
    **A.VIEWS,
    "sessions": """
        SELECT session_id, user_id, pc, start_time, end_time,
            date_diff('microsecond', start_time, end_time) / CAST(6e7 AS DOUBLE) AS duration_minutes,
            CAST(extract(hour FROM start_time) AS INTEGER) AS start_hour,
            CAST(extract(dow FROM start_time) AS INTEGER) AS day_of_week,
            CASE WHEN extract(dow FROM start_time) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
            CASE WHEN extract(hour FROM start_time) < 6 OR extract(hour FROM start_time) >= 18
                THEN 1 ELSE 0 END AS is_after_hours
        FROM (SELECT id AS session_id, user_id, pc, date AS start_time, activity,
                CASE WHEN next_activity IN ('Logoff', 'Logon') THEN next_time
                     WHEN next_time IS NULL THEN date + INTERVAL 8 HOUR
                     WHEN next_time - date > INTERVAL 12 HOUR THEN date + INTERVAL 8 HOUR
                     ELSE next_time END AS end_time
              FROM (SELECT *, lead(date) OVER w AS next_time, lead(activity) OVER w AS next_activity
                    FROM logon WINDOW w AS (PARTITION BY user_id, pc ORDER BY date, id)))
        WHERE activity = 'Logon' AND end_time > start_time""",
    "session_device": count_sql("device", DEVICE_SQL),
    "session_http": count_sql("http", HTTP_SQL),
    "session_email": count_sql("email", EMAIL_SQL),
    "session_file": count_sql("file", FILE_SQL),
    "features": f"""
        SELECT *, {_TOTAL} AS total_actions,
            CASE WHEN duration_minutes > 0 THEN ({_TOTAL}) / duration_minutes ELSE 0.0 END AS action_density
        FROM sessions JOIN session_device USING (session_id) JOIN session_http USING (session_id)
            JOIN session_email USING (session_id) JOIN session_file USING (session_id)""",
    "history": """
        SELECT *, last_week < (SELECT max(week) FROM snapshots) AS is_terminated FROM (
            SELECT user_id, week, role, department, prev_role,
                prev_role IS NOT NULL AND role IS DISTINCT FROM prev_role AS role_changed,
                prev_department,
                prev_department IS NOT NULL AND department IS DISTINCT FROM prev_department AS dept_changed,
                last_week
            FROM (SELECT *, lag(role) OVER w AS prev_role, lag(department) OVER w AS prev_department,
                    max(week) OVER (PARTITION BY user_id) AS last_week
                  FROM snapshots WINDOW w AS (PARTITION BY user_id ORDER BY week)))""",
    "latest": "SELECT * FROM history WHERE week = last_week",
    "enriched": """
        SELECT f.*, h.role, h.department, CASE WHEN h.role = 'ITAdmin' THEN 1 ELSE 0 END AS is_admin,
            coalesce(h.role_changed, FALSE) AS role_changed_this_month,
            coalesce(h.dept_changed, FALSE) AS dept_changed_this_month, h.prev_role,
            coalesce(h.is_terminated, FALSE) AS user_terminated, h.last_week,
            t.o AS openness, t.c AS conscientiousness, t.e AS extraversion, t.a AS agreeableness, t.n AS neuroticism
        FROM features f LEFT JOIN history h ON f.user_id = h.user_id
                AND strftime(date_trunc('week', f.start_time), '%Y-%m-%d') = h.week
            LEFT JOIN traits t ON f.user_id = t.user_id""",
    "labelled": """
        SELECT *, label_session AS label FROM (
            SELECT e.*,
                CASE WHEN e.user_id IN (SELECT user_id FROM incidents) THEN 1 ELSE 0 END AS label_user,
                CASE WHEN EXISTS (SELECT 1 FROM incidents i WHERE i.user_id = e.user_id
                    AND e.start_time BETWEEN i.inc_start AND i.inc_end) THEN 1 ELSE 0 END AS label_session
            FROM enriched e)""",
}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
