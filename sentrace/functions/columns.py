"""Scalar expressions as SQL text, for ``selectExpr``, ``where`` and ``F.expr``.

Arguments are SQL text too (most often a column name), so expressions nest by plain
string formatting and reach the JVM in one call.
"""

from __future__ import annotations

ARCHIVE_SUFFIXES = (".zip", ".rar")


def struct_of(columns) -> str:
    return f"struct({', '.join(columns)})"


def url_host(url: str) -> str:
    """Host part of a URL; NULL stays NULL."""
    return f"split_part(replace(replace({url}, 'http://', ''), 'https://', ''), '/', 1)"


def is_exe(name: str) -> str:
    return f"endswith({name}, '.exe')"


def is_doc(name: str) -> str:
    return f"contains({name}, '.doc')"


def is_pdf(name: str) -> str:
    return f"endswith({name}, '.pdf')"


def is_archive(name: str) -> str:
    return "(" + " OR ".join(f"endswith({name}, '{s}')" for s in ARCHIVE_SUFFIXES) + ")"


def file_kind(name: str) -> str:
    """One label per file name, in the order exe, doc, pdf, archive, other."""
    return f"""CASE WHEN {is_exe(name)} THEN 'exe' WHEN {is_doc(name)} THEN 'doc' WHEN {is_pdf(name)} THEN 'pdf'
        WHEN {is_archive(name)} THEN 'archive' WHEN {name} IS NOT NULL THEN 'other' END"""


def text_literal(value: str) -> str:
    """A SQL text literal, whatever the value holds."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mail_sent(user: str, sender: str) -> str:
    return f"contains({sender}, {user})"


def mail_received(user: str, to: str, cc: str, bcc: str) -> str:
    return f"(contains({to}, {user}) OR contains({cc}, {user}) OR contains({bcc}, {user}))"


def mail_external(to: str, domain: str) -> str:
    return f"NOT contains({to}, {text_literal(domain)})"


def mail_direction(user: str, sender: str, to: str, cc: str, bcc: str) -> str:
    """'sent', 'received', 'both' or 'none'; unknown counts as no."""
    sent, received = mail_sent(user, sender), mail_received(user, to, cc, bcc)
    return f"""CASE WHEN {sent} AND {received} THEN 'both' WHEN {sent} THEN 'sent'
        WHEN {received} THEN 'received' ELSE 'none' END"""


def period_of(ts: str, pattern: str = "yyyy-MM") -> str:
    return f"date_format({ts}, '{pattern}')"


def week_of(ts: str) -> str:
    """Monday of the week as yyyy-MM-dd."""
    return f"date_format(date_trunc('week', {ts}), 'yyyy-MM-dd')"


def minutes_between(start: str, end: str) -> str:
    return f"timestampdiff(MICROSECOND, {start}, {end}) / 6e7D"


def hours_between(start: str, end: str) -> str:
    return f"timestampdiff(MICROSECOND, {start}, {end}) / 3.6e9D"


def clamp_hours(start: str, end: str) -> str:
    """Hours from start to end, never negative."""
    return f"greatest(0D, {hours_between(start, end)})"


def time_bucket(ts: str, seconds: int) -> str:
    """Number of the fixed-width time slice holding ``ts``; grows with ``ts``."""
    since = f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"
    return f"CAST(floor({since} / {seconds}) AS BIGINT)"


def pad_array(values: str, length: int, pad: str) -> str:
    """Repeat ``pad`` in front of ``values`` up to ``length``."""
    return f"concat(array_repeat({pad}, greatest(0, {length} - size({values}))), {values})"


def pad_mask(n_real: str, length: int) -> str:
    """0 for padded steps, 1 for real ones."""
    return (
        f"concat(array_repeat(0, greatest(0, {length} - CAST({n_real} AS INT))),"
        f" array_repeat(1, least({length}, CAST({n_real} AS INT))))"
    )


def ratio(numerator: str, denominator: str) -> str:
    """0.0 where the denominator is 0."""
    return f"CASE WHEN {denominator} = 0 THEN 0D ELSE CAST({numerator} AS DOUBLE) / {denominator} END"
