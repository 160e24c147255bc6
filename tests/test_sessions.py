"""Session rules, and activity counts against brute force."""

import datetime as dt
import random

import pytest
from checking import table

from sentrace.operators import sessions as S
from sentrace.operators.intervals import sums_before

LOGON = "id string, date ntz, user_id string, pc string, activity string"


def run(spark, rows):
    got = S.sessions(table(spark, rows, LOGON)).collect()
    return {r["session_id"]: r for r in got}


def at(text):
    return dt.datetime.fromisoformat(text)


CASES = {
    "logoff": ([("a", "2024-01-01 09:00", "Logon"), ("b", "2024-01-01 17:00", "Logoff")], "2024-01-01 17:00"),
    "next logon": ([("a", "2024-01-01 09:00", "Logon"), ("b", "2024-01-01 10:00", "Logon")], "2024-01-01 10:00"),
    "nothing follows": ([("a", "2024-01-01 09:00", "Logon")], "2024-01-01 17:00"),
    "other after 13 hours": ([("a", "2024-01-01 09:00", "Logon"), ("b", "2024-01-01 22:00", "Lock")], "2024-01-01 17:00"),
    "other within 12 hours": ([("a", "2024-01-01 09:00", "Logon"), ("b", "2024-01-01 21:00", "Lock")], "2024-01-01 21:00"),
    "logoff after 30 hours": ([("a", "2024-01-01 09:00", "Logon"), ("b", "2024-01-02 15:00", "Logoff")], "2024-01-02 15:00"),
    "logoff after 40 days": ([("a", "2024-01-01 09:00", "Logon"), ("b", "2024-02-10 09:00", "Logoff")], "2024-02-10 09:00"),
}


@pytest.mark.parametrize("name", CASES)
def test_session_end(spark, name):
    rows, end = CASES[name]
    got = run(spark, [(i, t, "u", "p", a) for i, t, a in rows])
    assert got["a"]["end_time"] == at(end)


def test_no_session(spark):
    rows = [
        ("a", "2024-01-01 09:00", "u", "p", "Logoff"),
        ("b", "2024-01-02 09:00", "v", "p", "Logon"),
        ("c", "2024-01-02 09:00", "v", "p", "Logoff"),
    ]
    assert run(spark, rows) == {}


def test_time_flags(spark):
    rows = [
        ("sun", "2024-01-07 05:59", "u", "a", "Logon"),
        ("sat", "2024-01-06 06:00", "u", "b", "Logon"),
        ("mon", "2024-01-08 17:59", "u", "c", "Logon"),
        ("eve", "2024-01-08 18:00", "u", "d", "Logon"),
    ]
    got = run(spark, rows)
    flags = {k: (r["day_of_week"], r["is_weekend"], r["is_after_hours"]) for k, r in got.items()}
    assert flags == {"sun": (0, 1, 1), "sat": (6, 1, 0), "mon": (1, 0, 0), "eve": (1, 0, 1)}
    assert got["sun"]["duration_minutes"] == 480.0


def test_ties_are_ordered_by_id(spark):
    rows = [
        ("a", "2024-01-01 09:00", "u", "p", "Logon"),
        ("b", "2024-01-01 10:00", "u", "p", "Logoff"),
        ("c", "2024-01-01 10:00", "u", "p", "Logon"),
    ]
    assert set(run(spark, rows)) == {"a", "c"}


SESSIONS = "session_id string, user_id string, pc string, start_time ntz, end_time ntz"


def overlapping(spark):
    rows = [
        ("s1", "u", "p1", "2024-01-01 09:00", "2024-01-01 12:00"),
        ("s2", "u", "p2", "2024-01-01 10:00", "2024-01-03 10:00"),
        ("s3", "v", "p1", "2024-01-01 09:00", "2024-01-01 12:00"),
    ]
    return table(spark, rows, SESSIONS)


def test_event_counts_in_every_overlapping_session(spark):
    device = table(
        spark,
        [
            (1, "u", "2024-01-01 09:00", "Connect", "p1"),
            (2, "u", "2024-01-01 11:00", "Disconnect", "p1"),
            (3, "u", "2024-01-01 12:00", "Connect", "p1"),
        ],
        "id int, user_id string, date ntz, activity string, pc string",
    )
    ses = overlapping(spark)
    counts = {r["session_id"]: tuple(r)[1:] for r in S.session_device(ses, device).collect()}
    assert counts == {"s1": (2, 1, 1), "s2": (2, 1, 1), "s3": (0, 0, 0)}
    compat = {r["session_id"]: tuple(r)[1:] for r in S.session_device(ses, device, count_mode="compat").collect()}
    assert compat["s3"] == (1, 0, 0)
    pairs = {(r["session_id"], r["id"]) for r in S.events_in_session(ses, device).collect()}
    assert pairs == {("s1", 1), ("s1", 2), ("s2", 2), ("s2", 3)}
    own = {(r["session_id"], r["id"]) for r in S.events_in_session(ses, device, match_pc=True).collect()}
    assert own == {("s1", 1), ("s1", 2)}
    with pytest.raises(ValueError):
        S.session_device(ses, device, count_mode="other")


def test_mail_rules(spark):
    mail = table(
        spark,
        [
            (1, "u", "2024-01-01 09:30", None, None, None, "u@dtaa.com", 5, 1),
            (2, "u", "2024-01-01 09:31", "x@else.org", "u@dtaa.com", None, "z@dtaa.com", None, 2),
        ],
        "id int, user_id string, date ntz, to_addr string, cc_addr string, bcc_addr string, from_addr string,"
        " size bigint, attachments bigint",
    )
    got = S.session_email(overlapping(spark), mail).where("session_id = 's1'").first()
    assert tuple(got)[1:] == (2, 1, 1, 3, 5, 1)


def random_case(spark, seed, n_events=400):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    when = lambda minutes: (base + dt.timedelta(minutes=minutes)).isoformat(sep=" ")
    sessions, number = [], 0
    for user in ("u", "v"):
        for pc in ("p1", "p2", "p3"):
            at_minute = rng.randrange(50)
            while at_minute < 3000:
                end = at_minute + rng.choice([1, 7, 30, 200, 900])
                sessions.append((f"s{number}", user, pc, when(at_minute), when(end)))
                number += 1
                at_minute = end + rng.choice([0, 0, 3, 100])
    events = [(i, rng.choice("uuuvw"), when(rng.randrange(3100)), f"h{rng.randrange(6)}") for i in range(n_events)]
    return sessions, events


@pytest.mark.parametrize("seed,slice_seconds", [(1, 60), (2, 3600), (3, 86400)])
def test_counts_and_hosts_equal_brute_force(spark, seed, slice_seconds):
    sessions, events = random_case(spark, seed)
    ses = table(spark, sessions, SESSIONS)
    http = table(spark, [(i, u, t, f"http://{h}/x/{i}") for i, u, t, h in events], "id int, user_id string, date ntz, url string")
    got = {r["session_id"]: tuple(r)[1:] for r in S.session_http(ses, http, slice_seconds=slice_seconds).collect()}
    pairs = {(r["session_id"], r["id"]) for r in S.events_in_session(ses, http, slice_seconds=slice_seconds).collect()}
    inside = {
        s: [(i, h) for i, u, t, h in events if u == user and start <= t < end]
        for s, user, _, start, end in sessions
    }
    assert got == {s: (len(e), len({h for _, h in e})) for s, e in inside.items()}
    assert pairs == {(s, i) for s, e in inside.items() for i, _ in e}


def test_sums_before_respects_ties(spark):
    points = table(spark, [("u", "2024-01-01 10:00", "a")], "k string, ts ntz, name string")
    events = table(
        spark,
        [("u", "2024-01-01 10:00", -1, 1), ("u", "2024-01-01 10:00", 1, 10), ("u", "2023-12-30 10:00", 1, 100)],
        "k string, ts ntz, tie int, n int",
    )
    got = sums_before(points, events, "k", {"total": "n"}, event_tie="tie").first()
    assert (got["name"], got["total"]) == ("a", 101)
