"""Time slices that follow the data: one user has nearly all rows, in one hour, many of them at one second."""

import random

import pytest

from sentrace.operators import intervals, ordered, sequences, sessions

LIMIT = 40


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", LIMIT)
    monkeypatch.setattr(ordered, "LEAST_ROW_BYTES", 0)


@pytest.fixture(scope="module")
def events(spark):
    random.seed(6)
    rows = []
    for i in range(3000):
        if i % 10:
            micros = random.choice([random.randrange(3600 * 10**6), 1800 * 10**6 + random.randrange(10**6), 7 * 10**6 + random.randrange(300)])
            rows.append((i, "hot", 1_700_000_000_000_000 - 1_700_000_000_000_000 % (86400 * 10**6) + micros))
        else:
            rows.append((i, random.choice(["a", "b", None]), random.randrange(10**15) * 2 - 10**14))
    rows += [(9000, "hot", None), (9001, None, None)] + [(9100 + k, "tie", 5_000_000) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, user_id string, us long")
    return df.selectExpr("id", "user_id", "CAST(timestamp_micros(us) AS TIMESTAMP_NTZ) AS date").cache()


def test_slices_are_bounded_and_grow_with_time(events, small):
    got = ordered.time_slices(events, ["user_id"], "date", 21600)
    assert got.columns == [*events.columns, "_slice"] and got.count() == events.count()
    sizes = {(r["user_id"], r["_slice"]): r["count"] for r in got.where("date IS NOT NULL").groupBy("user_id", "_slice").count().collect()}
    assert max(n for (user, _), n in sizes.items() if user == "hot") <= 2 * LIMIT
    assert sum(user == "hot" for user, _ in sizes) > 60
    assert max(n for (user, _), n in sizes.items() if user == "tie") == 90  # one microsecond
    rows = sorted((str(r["user_id"]), r["date"], r["_slice"]) for r in got.where("date IS NOT NULL").collect())
    assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])


def test_no_look_at_small_tables(events):
    plan = ordered.time_slices(events, ["user_id"], "date", 3600)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def both(monkeypatch, make):
    plain = make()
    before = sorted(map(str, plain.collect()))
    monkeypatch.setattr(ordered, "SLICE_ROWS", LIMIT)
    monkeypatch.setattr(ordered, "LEAST_ROW_BYTES", 0)
    cut = make()
    assert "_second" in cut._jdf.queryExecution().optimizedPlan().toString() or "slice-starts" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, cut.collect())) == before
    return before


def test_sessions_and_counts_are_the_same(spark, events, monkeypatch):
    logon = events.where("date IS NOT NULL").selectExpr("*", "'PC' AS pc", "CASE id % 3 WHEN 0 THEN 'Logon' WHEN 1 THEN 'Logoff' ELSE 'Lock' END AS activity")
    assert len(both(monkeypatch, lambda: sessions.sessions(logon))) > 500
    monkeypatch.undo()
    made = sessions.sessions(logon).cache()
    web = events.where("date IS NOT NULL").selectExpr("user_id", "date", "concat('http://h', id % 7, '.org/x') AS url")
    both(monkeypatch, lambda: sessions.session_http(made, web))
    monkeypatch.undo()
    both(monkeypatch, lambda: intervals.sums_inside(made, events.where("date IS NOT NULL"), "user_id", {"n": "1", "s": "id"}))


def test_sequences_are_the_same(events, monkeypatch):
    rows = events.where("date IS NOT NULL").selectExpr("id AS session_id", "user_id", "date AS start_time", "array(CAST(id AS DOUBLE)) AS features")
    both(monkeypatch, lambda: sequences.sequences(rows, 5))
