"""Sessions, activity counts, directory joins and reports on them."""

from __future__ import annotations


from sentrace.functions.columns import week_of
from sentrace.operators import directory, sessions
from sentrace.plans import adapters as A
from sentrace.plans.base import (
    ALL_COUNTS,
    build_features,
    build_sessions,
    history,
    stored,
    with_views,
)

QUERIES = {
    "sessions": build_sessions,
    "events_in_session": lambda s, d: sessions.events_in_session(stored(s, d, "sessions"), A.device(s, d)),
    "session_device": lambda s, d: sessions.session_device(stored(s, d, "sessions"), A.device(s, d)),
    "session_http": lambda s, d: sessions.session_http(stored(s, d, "sessions"), A.http(s, d)),
    "session_email": lambda s, d: sessions.session_email(stored(s, d, "sessions"), A.email(s, d)),
    "session_file": lambda s, d: sessions.session_file(stored(s, d, "sessions"), A.file(s, d)),
    "session_features": build_features,
    "session_features_compat": lambda s, d: build_features(s, d, "compat"),
    "feature_summary": lambda s, d: sessions.feature_summary(stored(s, d, "features")),
    "snapshot_changes": history,
    "snapshot_latest": lambda s, d: directory.snapshot_latest(history(s, d), period="week"),
    "enrich_directory": lambda s, d: directory.enrich_directory(
        stored(s, d, "features"), history(s, d), session_period=week_of("start_time"), period="week"
    ).select(
        "session_id",
        "user_id",
        "role",
        "department",
        "is_admin",
        "role_changed_this_month",
        "dept_changed_this_month",
        "prev_role",
        "user_terminated",
        "last_week",
    ),
    "enrich_directory_latest": lambda s, d: directory.enrich_directory_latest(
        stored(s, d, "features"), directory.snapshot_latest(history(s, d), period="week")
    ).select("session_id", "user_id", "role", "department", "is_admin", "user_terminated"),
    "enrich_traits": lambda s, d: directory.enrich_traits(stored(s, d, "features"), A.traits(s, d)).select(
        "session_id", *directory.TRAIT_NAMES.values()
    ),
    "directory_summary": lambda s, d: directory.directory_summary(stored(s, d, "enriched")),
}

_COMPAT = ", ".join(
    f"greatest({c}, 1) AS {c}" if c in sessions.TOTALS else c for c in ALL_COUNTS
)
_COMPAT_TOTAL = " + ".join(f"greatest({c}, 1)" for c in sessions.TOTALS)

ORACLE = {
    "sessions": with_views("sessions", body="SELECT * FROM sessions"),
    "events_in_session": with_views(
        "sessions",
        "device",
        body="""SELECT s.session_id, e.user_id, e.id, e.date, e.activity FROM sessions s JOIN device e
            ON e.user_id = s.user_id AND e.date >= s.start_time AND e.date < s.end_time""",
    ),
    "session_device": with_views("session_device", body="SELECT * FROM session_device"),
    "session_http": with_views("session_http", body="SELECT * FROM session_http"),
    "session_email": with_views("session_email", body="SELECT * FROM session_email"),
    "session_file": with_views("session_file", body="SELECT * FROM session_file"),
    "session_features": with_views("features", body="SELECT * FROM features"),
    "session_features_compat": with_views(
        "features",
        body=f"""SELECT session_id, user_id, pc, start_time, end_time, duration_minutes, start_hour, day_of_week,
            is_weekend, is_after_hours, {_COMPAT}, {_COMPAT_TOTAL} AS total_actions,
            CASE WHEN duration_minutes > 0 THEN ({_COMPAT_TOTAL}) / duration_minutes ELSE 0.0 END AS action_density
            FROM features""",
    ),
    "feature_summary": with_views(
        "features",
        body="""SELECT avg(duration_minutes) AS avg_duration, avg(total_actions) AS avg_actions,
            avg(file_copy_count) AS avg_file_copies,
            CAST(sum(CASE WHEN usb_connect_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS sessions_with_usb
            FROM features""",
    ),
    "snapshot_changes": with_views("history", body="SELECT * FROM history"),
    "snapshot_latest": with_views("latest", body="SELECT * FROM latest"),
    "enrich_directory": with_views(
        "enriched",
        body="""SELECT session_id, user_id, role, department, is_admin, role_changed_this_month,
            dept_changed_this_month, prev_role, user_terminated, last_week FROM enriched""",
    ),
    "enrich_directory_latest": with_views(
        "features",
        "latest",
        body="""SELECT session_id, user_id, role, department,
            CASE WHEN role = 'ITAdmin' THEN 1 ELSE 0 END AS is_admin,
            coalesce(is_terminated, FALSE) AS user_terminated
            FROM features LEFT JOIN latest USING (user_id)""",
    ),
    "enrich_traits": with_views(
        "enriched",
        body="""SELECT session_id, openness, conscientiousness, extraversion, agreeableness, neuroticism
            FROM enriched""",
    ),
    "directory_summary": with_views(
        "enriched",
        body="""SELECT count(DISTINCT role) AS distinct_roles,
            count(*) FILTER (WHERE role_changed_this_month) AS sessions_with_role_change,
            count(*) FILTER (WHERE user_terminated) AS sessions_by_terminated FROM enriched""",
    ),
}
