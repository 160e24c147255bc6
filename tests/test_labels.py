import datetime as dt
import random

import pytest
from checking import table

from sentrace.operators import features as X
from sentrace.operators import labels as L
from sentrace.operators.sequences import sequences

SESSIONS = "session_id string, user_id string, start_time ntz"
INCIDENTS = "user_id string, inc_start ntz, inc_end ntz"


def test_windows_are_closed_and_may_overlap(spark):
    sessions = table(
        spark,
        [
            ("at start", "u", "2024-01-02 00:00"),
            ("at end", "u", "2024-01-20 12:00"),
            ("inside both", "u", "2024-01-05 00:00"),
            ("between", "u", "2024-01-10 00:00"),
            ("after", "u", "2024-01-20 12:01"),
            ("other user", "v", "2024-01-05 00:00"),
            ("listed", "w", "2024-01-05 00:00"),
        ],
        SESSIONS,
    )
    incidents = table(
        spark,
        [
            ("u", "2024-01-02 00:00", "2024-01-06 00:00"),
            ("u", "2024-01-03 00:00", "2024-01-07 00:00"),
            ("u", "2024-01-20 00:00", "2024-01-20 12:00"),
            ("w", None, "2024-01-06 00:00"),
        ],
        INCIDENTS,
    )
    got = {r["session_id"]: (r["label_user"], r["label"]) for r in L.label_sessions(sessions, incidents, incidents).collect()}
    assert got == {
        "at start": (1, 1),
        "at end": (1, 1),
        "inside both": (1, 1),
        "between": (1, 0),
        "after": (1, 0),
        "other user": (0, 0),
        "listed": (1, 0),
    }
    for none in (None, incidents.limit(0)):
        rows = L.label_sessions(sessions, incidents, none).collect()
        assert {r["session_id"]: r["label"] for r in rows}["between"] == 1


def test_labels_equal_brute_force(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    stamp = lambda h: (base + dt.timedelta(hours=h)).isoformat(sep=" ")
    sessions = [(str(i), rng.choice("aab"), stamp(rng.randrange(800))) for i in range(300)]
    incidents = []
    for _ in range(25):
        start = rng.randrange(800)
        incidents.append((rng.choice("ab"), stamp(start), stamp(start + rng.randrange(60))))
    frame = table(spark, incidents, INCIDENTS)
    rows = L.label_sessions(table(spark, sessions, SESSIONS), frame, frame).collect()
    assert len(rows) == 300
    for r in rows:
        text = r["start_time"].isoformat(sep=" ")
        assert r["label"] == int(any(u == r["user_id"] and s <= text <= e for u, s, e in incidents))


@pytest.fixture(scope="module")
def hourly(spark):
    """100 hourly sessions of 5 users; one of them is the insider the whole time."""
    rng = random.Random(1)
    base = dt.datetime(2022, 1, 1)
    columns = "duration_minutes is_weekend is_after_hours file_copy_count total_actions action_density".split()
    rows = [
        (f"sess_{i}", f"user_{i % 5}", (base + dt.timedelta(hours=i)).isoformat(sep=" "), *[rng.random() for _ in columns], "Employee")
        for i in range(100)
    ]
    schema = SESSIONS + ", " + ", ".join(f"{c} double" for c in columns) + ", role string"
    incident = table(spark, [("user_4", rows[0][2], rows[-1][2])], INCIDENTS)
    return table(spark, rows, schema), incident


def test_prepare_random(hourly):
    features, incident = hourly
    out = L.prepare_random(features, incident, incident, 10, train=0.5, val=0.2, role_mode="roles")
    rows = out.sequences.collect()
    assert len(rows) == 100 == len({r["session_id"] for r in rows})
    counts = {}
    for r in rows:
        counts[r["split"]] = counts.get(r["split"], 0) + 1
    assert counts == {"train": 40, "val": 16, "test": 44}
    assert all(r["label_user"] == 0 for r in rows if r["split"] != "test")
    assert sum(r["label_session"] for r in rows) == 20
    assert out.model.names[-1] == "role_Employee"
    for r in rows:
        assert len(r["seq"]) == len(r["mask"]) == 10 and {len(v) for v in r["seq"]} == {len(out.model.names)}
        assert r["mask"] == sorted(r["mask"]) and r["mask"][-1] == 1
    by_user = sorted((r["start_time"], sum(r["mask"])) for r in rows if r["user_id"] == "user_1")
    assert [n for _, n in by_user] == [min(10, i + 1) for i in range(20)]
    same = L.prepare_random(features, incident, incident, 10, train=0.5, val=0.2).sequences
    assert {(r["session_id"], r["split"]) for r in same.collect()} == {(r["session_id"], r["split"]) for r in rows}


def test_prepare_random_with_everyone(hourly):
    features, incident = hourly
    split = L.split_random(L.label_sessions(features, incident, incident), 0.5, 0.2, normal_only=False)
    counts = {(r["split"], r["split_group"]): r["count"] for r in split.groupBy("split", "split_group").count().collect()}
    assert counts == {("train", "normal"): 50, ("val", "normal"): 20, ("test", "normal"): 30, ("test", "insider"): 20}


def test_prepare_temporal(hourly):
    features, incident = hourly
    out = L.prepare_temporal(features, incident, incident, 10, train=0.5, val=0.25)
    rows = out.sequences.collect()
    # 99 hours are four whole days: cuts after 2 and 3 days.
    assert {r["split"] for r in rows} == {"train", "val", "test"}
    assert sum(r["split"] == "train" for r in rows) == 48 - len([i for i in range(48) if i % 5 == 4])
    assert sum(r["split"] == "test" for r in rows) == 100 - 72
    firsts = {}
    for r in rows:
        key = (r["user_id"], r["split"])
        firsts[key] = min(firsts.get(key, 99), sum(r["mask"]))
    assert set(firsts.values()) == {1}
    assert out.metadata.count() == 3


def test_cutoff_truncates_in_binary(spark):
    rows = [("a", "u", "2020-01-01 00:00"), ("b", "u", "2021-05-15 00:00")]
    cut = L.cutoffs(table(spark, rows, SESSIONS)).first()
    days = [(cut[c] - dt.datetime(2020, 1, 1)).days for c in ("train_cutoff", "val_cutoff")]
    assert days == [350, 399]


def test_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "session_id")
    one = {r[0] for r in L.sample_sessions(df, 700, 1).collect()}
    assert len(one) == 700 and one == {r[0] for r in L.sample_sessions(df.repartition(7), 700, 1).collect()}
    assert one != {r[0] for r in L.sample_sessions(df, 700, 2).collect()}
    assert L.sample_sessions(df, 9000).count() == 5000


def test_history_uses_own_rows_of_the_user(spark):
    rows = [("a", "u", "2024-01-01 00:00", [1.0]), ("b", "v", "2024-01-01 01:00", [2.0]), ("c", "u", "2024-01-01 02:00", [3.0])]
    df = table(spark, rows, SESSIONS + ", features array<double>")
    got = {r["session_id"]: (r["seq"], r["mask"]) for r in sequences(df, 3, [9.0]).collect()}
    assert got == {
        "a": ([[9.0], [9.0], [1.0]], [0, 0, 1]),
        "b": ([[9.0], [9.0], [2.0]], [0, 0, 1]),
        "c": ([[9.0], [1.0], [3.0]], [0, 1, 1]),
    }
    zeros = {r["session_id"]: r["seq"] for r in sequences(df, 2).collect()}
    assert zeros["b"] == [[0.0], [2.0]]
    assert X.ROLE_MODES == ("none", "roles", "units")
