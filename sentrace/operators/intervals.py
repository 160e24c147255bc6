"""Joins and sums between time intervals and timed events of the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.functions.columns import struct_of, time_bucket
from sentrace.operators.ordered import running_sums, time_slices

SLICE = 6 * 3600  # default width of the time slices of one key
DAY = 86400


def sums_before(
    points: DataFrame,
    events: DataFrame,
    key: str,
    sums: dict[str, str],
    *,
    point_time: str = "ts",
    event_time: str = "ts",
    event_tie: str = "1",
    slice_seconds: int = SLICE,
) -> DataFrame:
    """Adds to each point the sums over all events of its key before the point.

    Events at the very time of a point count only if ``event_tie`` is below 0. No pairs of
    points and events are built: both run through one ordered running sum.
    """
    held = [c for c in points.columns if c != key]
    measures = [c for c in events.columns if c not in (key, event_time)]
    point_rows = points.selectExpr(
        key, f"{point_time} AS _ts", "0 AS _tie", f"{struct_of(held)} AS _point"
    )
    # A NULL key equals no key, so such events are before no point.
    event_rows = events.where(f"{key} IS NOT NULL AND {event_time} IS NOT NULL").selectExpr(
        key, f"{event_time} AS _ts", f"{event_tie} AS _tie", *measures
    )
    stream = time_slices(point_rows.unionByName(event_rows, allowMissingColumns=True), [key], "_ts", slice_seconds)
    guarded = {n: f"CASE WHEN _point IS NULL THEN coalesce({text}, 0) ELSE 0 END" for n, text in sums.items()}
    out = running_sums(stream, [key], ["_ts", "_tie"], "_slice", guarded)
    return out.where("_point IS NOT NULL").selectExpr(key, *[f"_point.{c} AS {c}" for c in held], *sums)


def sums_inside(
    intervals: DataFrame,
    events: DataFrame,
    key: str,
    sums: dict[str, str],
    *,
    interval_id: str = "session_id",
    start: str = "start_time",
    end: str = "end_time",
    event_time: str = "date",
    slice_seconds: int = SLICE,
) -> DataFrame:
    """Sums over the events of the key in [start, end), one row per interval.

    A sum inside an interval is the sum before its end less the sum before its start, so
    the work is linear in events plus intervals, however much intervals overlap.
    """
    bounds = intervals.selectExpr(
        key, interval_id, f"inline(array(struct({start} AS ts, -1 AS _sign), struct({end} AS ts, 1 AS _sign)))"
    )
    before = sums_before(bounds, events, key, sums, event_time=event_time, slice_seconds=slice_seconds)
    return before.groupBy(interval_id).agg(*[F.expr(f"sum(_sign * {n}) AS {n}") for n in sums])


def interval_slices(
    intervals: DataFrame, start: str, end: str, slice_seconds: int, *, closed: bool = False
) -> DataFrame:
    """One row per interval and time slice it touches, as ``_slice``."""
    first = time_bucket(start, slice_seconds)
    last = time_bucket(end if closed else f"({end} - INTERVAL '0.000001' SECOND)", slice_seconds)
    return intervals.selectExpr("*", f"explode(sequence({first}, greatest({first}, {last}))) AS _slice")


def events_inside(
    intervals: DataFrame,
    events: DataFrame,
    *,
    key: str = "user_id",
    lane: str = "pc",
    interval_id: str = "session_id",
    start: str = "start_time",
    end: str = "end_time",
    event_time: str = "date",
    match_lane: bool = False,
    slice_seconds: int = SLICE,
) -> DataFrame:
    """Pairs of interval and event of the same key with start <= event < end.

    Intervals are cut into time slices and joined with events on key and slice; the time
    condition is part of the join, so only real pairs leave it, and adaptive execution
    splits a hot (key, slice). Intervals may overlap. A NULL key (with ``match_lane`` also a
    NULL lane) matches nothing.
    """
    fields = [c for c in events.columns if c != key and not (match_lane and c == lane)]
    pieces = interval_slices(
        intervals.where(f"{end} > {start}").select(key, lane, interval_id, start, end), start, end, slice_seconds
    ).selectExpr(
        f"{key} AS _key", "_slice AS _of", f"{lane} AS _lane", interval_id, f"{start} AS _start", f"{end} AS _end"
    )
    rows = events.selectExpr(
        key,
        *([lane] if match_lane else []),
        f"{time_bucket(event_time, slice_seconds)} AS _slice",
        f"{event_time} AS _ts",
        f"{struct_of(fields)} AS _event",
    )
    same = f"{key} = _key AND _slice = _of AND _ts >= _start AND _ts < _end"
    if match_lane:
        same += f" AND {lane} = _lane"
    return rows.join(pieces, F.expr(same)).selectExpr(
        interval_id, key, *[f"_event.{f} AS {f}" for f in fields], *([lane] if match_lane else [])
    )


def first_per_epoch(
    events: DataFrame,
    starts: DataFrame,
    value: str,
    *,
    key: str = "user_id",
    event_time: str = "date",
    start: str = "start_time",
    slice_seconds: int = SLICE,
) -> DataFrame:
    """Drops repeats of ``value`` that no interval can tell apart from an earlier one.

    Between two starts of the key, only the first event with a value can be the first of
    that value inside any interval. Distinct counts per interval stay exact while repeats
    are gone before they are matched with intervals.
    """
    marks = starts.selectExpr(key, f"{start} AS _ts", "1 AS _mark")
    rows = events.where(f"{value} IS NOT NULL AND {key} IS NOT NULL").selectExpr(
        key, f"{event_time} AS _ts", "0 AS _mark", value
    )
    epoch = f"""sum(_mark) OVER (PARTITION BY {key}, _slice ORDER BY _ts, _mark DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _epoch"""
    return (
        time_slices(rows.unionByName(marks, allowMissingColumns=True), [key], "_ts", slice_seconds)
        .selectExpr("*", epoch)
        .where("_mark = 0")
        .groupBy(key, "_slice", "_epoch", value)
        .agg(F.expr(f"min(_ts) AS {event_time}"))
        .select(key, event_time, value)
    )
