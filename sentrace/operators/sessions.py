"""Sessions from logon events, and per-session activity counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.functions import columns as C
from sentrace.operators.intervals import DAY, SLICE, events_inside, first_per_epoch, sums_inside
from sentrace.operators.ordered import next_in_order, time_slices

DEFAULT_DOMAIN = "@dtaa.com"
COUNT_MODES = ("true", "compat")
# The count of a log that becomes 1 instead of 0 in an event-less session in compat mode.
TOTALS = ("device_event_count", "http_request_count", "email_count", "file_copy_count")

DEVICE_COLUMNS = ("device_event_count", "usb_connect_count", "usb_disconnect_count")
HTTP_COLUMNS = ("http_request_count", "unique_domains")
EMAIL_COLUMNS = (
    "email_count",
    "emails_sent",
    "emails_received",
    "total_attachments",
    "total_email_size",
    "external_email_count",
)
FILE_COLUMNS = (
    "file_copy_count",
    "exe_copy_count",
    "doc_copy_count",
    "pdf_copy_count",
    "archive_copy_count",
)


def sessions(
    logon: DataFrame, *, max_gap: str = "12 HOURS", cap: str = "8 HOURS", slice_seconds: int = DAY
) -> DataFrame:
    """Pair every Logon with the next activity of the same user and machine.

    The next Logoff or Logon ends the session however late it comes. Any other activity
    ends it too unless it is more than ``max_gap`` away; then, and when nothing follows,
    the session lasts ``cap``. Sessions without positive length are dropped.
    """
    ordered = time_slices(logon.select("id", "date", "user_id", "pc", "activity"), ["user_id", "pc"], "date", slice_seconds)
    following = next_in_order(
        ordered, ["user_id", "pc"], ["date", "id"], "_slice", {"next_time": "date", "next_activity": "activity"}
    )
    end = f"""CASE WHEN next_activity IN ('Logoff', 'Logon') THEN next_time
        WHEN next_time IS NULL OR next_time - date > INTERVAL {max_gap} THEN date + INTERVAL {cap}
        ELSE next_time END"""
    return (
        following.where("activity = 'Logon'")
        .selectExpr("id AS session_id", "user_id", "pc", "date AS start_time", f"{end} AS end_time")
        .where("end_time > start_time")
        .selectExpr(
            "*",
            f"{C.minutes_between('start_time', 'end_time')} AS duration_minutes",
            "hour(start_time) AS start_hour",
            "dayofweek(start_time) - 1 AS day_of_week",
            "CASE WHEN dayofweek(start_time) IN (1, 7) THEN 1 ELSE 0 END AS is_weekend",
            "CASE WHEN hour(start_time) < 6 OR hour(start_time) >= 18 THEN 1 ELSE 0 END AS is_after_hours",
        )
    )


def events_in_session(
    sessions: DataFrame, events: DataFrame, *, match_pc: bool = False, slice_seconds: int = SLICE
) -> DataFrame:
    """(session_id, event columns) for every event inside a session of its user."""
    return events_inside(sessions, events, match_lane=match_pc, slice_seconds=slice_seconds)


# Each log becomes narrow rows (user, date, bit flags of the counted conditions, summed
# values); bits of different logs do not overlap, so the logs can share one pass.
_DEVICE_BITS, _HTTP_BITS, _EMAIL_BITS, _FILE_BITS = 0, 3, 4, 8

_DEVICE_CONDITIONS = ("true", "activity = 'Connect'", "activity = 'Disconnect'")
_HTTP_CONDITIONS = ("true",)
_FILE_CONDITIONS = (
    "true",
    C.is_exe("filename"),
    C.is_doc("filename"),
    C.is_pdf("filename"),
    C.is_archive("filename"),
)


def _email_conditions(domain: str) -> tuple[str, ...]:
    return (
        "true",
        C.mail_sent("user_id", "from_addr"),
        C.mail_received("user_id", "to_addr", "cc_addr", "bcc_addr"),
        C.mail_external("to_addr", domain),
    )


def _bit(index: int) -> str:
    return f"getbit(flags, {index})"


_DEVICE_SUMS = {c: _bit(_DEVICE_BITS + i) for i, c in enumerate(DEVICE_COLUMNS)}
_HTTP_SUMS = {"http_request_count": _bit(_HTTP_BITS)}
_FILE_SUMS = {c: _bit(_FILE_BITS + i) for i, c in enumerate(FILE_COLUMNS)}
_EMAIL_SUMS = {
    "email_count": _bit(_EMAIL_BITS),
    "emails_sent": _bit(_EMAIL_BITS + 1),
    "emails_received": _bit(_EMAIL_BITS + 2),
    "total_attachments": "attachments",
    "total_email_size": "size",
    "external_email_count": _bit(_EMAIL_BITS + 3),
}


def _flagged(log: DataFrame, conditions: tuple[str, ...], first_bit: int, *extra: str) -> DataFrame:
    bits = [f"CASE WHEN {c} THEN {1 << (first_bit + i)} ELSE 0 END" for i, c in enumerate(conditions)]
    return log.selectExpr("user_id", "date", f"{' + '.join(bits)} AS flags", *extra)


def _counted(sessions: DataFrame, counts: DataFrame, columns: tuple[str, ...], count_mode: str) -> DataFrame:
    """All sessions with 0 for what was not found; 1 for totals in compat mode."""
    if count_mode not in COUNT_MODES:
        raise ValueError(f"count_mode must be one of {COUNT_MODES}")
    least = {c: 1 if count_mode == "compat" and c in TOTALS else 0 for c in columns}
    return sessions.join(counts, "session_id", "left").selectExpr(
        *sessions.columns, *[f"CAST(greatest(coalesce({c}, 0), {least[c]}) AS BIGINT) AS {c}" for c in columns]
    )


def _log_counts(sessions, log, conditions, first_bit, sums, count_mode, slice_seconds, *extra) -> DataFrame:
    events = _flagged(log, conditions, first_bit, *extra)
    found = sums_inside(sessions, events, "user_id", sums, slice_seconds=slice_seconds)
    return _counted(sessions.select("session_id"), found, tuple(sums), count_mode)


def session_device(
    sessions: DataFrame, device: DataFrame, *, count_mode: str = "true", slice_seconds: int = SLICE
) -> DataFrame:
    return _log_counts(
        sessions, device, _DEVICE_CONDITIONS, _DEVICE_BITS, _DEVICE_SUMS, count_mode, slice_seconds
    )


def session_file(
    sessions: DataFrame, file: DataFrame, *, count_mode: str = "true", slice_seconds: int = SLICE
) -> DataFrame:
    return _log_counts(sessions, file, _FILE_CONDITIONS, _FILE_BITS, _FILE_SUMS, count_mode, slice_seconds)


def session_email(
    sessions: DataFrame,
    email: DataFrame,
    *,
    count_mode: str = "true",
    domain: str = DEFAULT_DOMAIN,
    slice_seconds: int = SLICE,
) -> DataFrame:
    conditions = _email_conditions(domain)
    return _log_counts(
        sessions, email, conditions, _EMAIL_BITS, _EMAIL_SUMS, count_mode, slice_seconds, "attachments", "size"
    )


def session_hosts(sessions: DataFrame, http: DataFrame, *, slice_seconds: int = SLICE) -> DataFrame:
    """Distinct web hosts per session, for the sessions that have any."""
    visits = http.selectExpr("user_id", "date", f"{C.url_host('url')} AS host")
    firsts = first_per_epoch(visits, sessions, "host", slice_seconds=slice_seconds)
    pairs = events_inside(sessions, firsts, slice_seconds=slice_seconds)
    return pairs.groupBy("session_id").agg(F.expr("count(DISTINCT host) AS unique_domains"))


def session_http(
    sessions: DataFrame, http: DataFrame, *, count_mode: str = "true", slice_seconds: int = SLICE
) -> DataFrame:
    events = _flagged(http, _HTTP_CONDITIONS, _HTTP_BITS)
    requests = sums_inside(sessions, events, "user_id", _HTTP_SUMS, slice_seconds=slice_seconds)
    hosts = session_hosts(sessions, http, slice_seconds=slice_seconds)
    counts = requests.join(hosts, "session_id", "left")
    return _counted(sessions.select("session_id"), counts, HTTP_COLUMNS, count_mode)


def session_features(
    sessions: DataFrame,
    device: DataFrame,
    http: DataFrame,
    email: DataFrame,
    file: DataFrame,
    *,
    count_mode: str = "true",
    domain: str = DEFAULT_DOMAIN,
    slice_seconds: int = SLICE,
) -> DataFrame:
    """Sessions with all activity counts; the four logs pass one shuffle together."""
    logs = [
        _flagged(device, _DEVICE_CONDITIONS, _DEVICE_BITS),
        _flagged(http, _HTTP_CONDITIONS, _HTTP_BITS),
        _flagged(email, _email_conditions(domain), _EMAIL_BITS, "attachments", "size"),
        _flagged(file, _FILE_CONDITIONS, _FILE_BITS),
    ]
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)
    sums = {**_DEVICE_SUMS, **_HTTP_SUMS, **_EMAIL_SUMS, **_FILE_SUMS}
    counts = sums_inside(sessions, events, "user_id", sums, slice_seconds=slice_seconds)
    hosts = session_hosts(sessions, http, slice_seconds=slice_seconds)
    columns = (*DEVICE_COLUMNS, *HTTP_COLUMNS, *EMAIL_COLUMNS, *FILE_COLUMNS)
    counted = _counted(sessions, counts.join(hosts, "session_id", "left"), columns, count_mode)
    return counted.selectExpr("*", f"{' + '.join(TOTALS)} AS total_actions").selectExpr(
        "*", "CASE WHEN duration_minutes > 0 THEN total_actions / duration_minutes ELSE 0D END AS action_density"
    )


def feature_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.expr("avg(duration_minutes) AS avg_duration"),
        F.expr("avg(total_actions) AS avg_actions"),
        F.expr("avg(file_copy_count) AS avg_file_copies"),
        F.expr("count_if(usb_connect_count > 0) AS sessions_with_usb"),
    )
