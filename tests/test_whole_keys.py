"""Small keys are not cut into time slices, and sums over steps are taken in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from sentrace.operators import intervals, ordered, scoring, sessions
from sentrace.plans import label_queries, metric_queries


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(9)
    data = [(i, random.choice(["a", "b", "c", None]), random.choice([random.randrange(10**13), None])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, user_id string, us long")
    made = df.selectExpr("id", "user_id", "CAST(timestamp_micros(us) AS TIMESTAMP_NTZ) AS date").cache()
    made.count()  # its size is known from here on
    return made


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def both(monkeypatch, make):
    """The rows with time slices and, checked to be equal, those with whole keys."""
    cut = make()
    before = sorted(map(str, cut.collect()))
    monkeypatch.setattr(ordered, "LEAST_ROW_BYTES", 0)  # small tables are looked at as well
    whole = make()
    assert sorted(map(str, whole.collect())) == before and before
    assert plan(whole).count("Aggregate") < plan(cut).count("Aggregate")


def test_sessions_of_small_keys_need_no_carry_rows(rows, monkeypatch):
    logon = rows.selectExpr("*", "'PC' AS pc", "CASE id % 3 WHEN 0 THEN 'Logon' WHEN 1 THEN 'Logoff' ELSE 'Lock' END AS activity")
    both(monkeypatch, lambda: sessions.sessions(logon))


def test_running_sums_of_small_keys_need_no_carry_rows(rows, monkeypatch):
    def make():
        sliced = ordered.time_slices(rows, ["user_id"], "date", 3600)
        sums = {"n": "1", "s": "CASE WHEN id % 4 > 0 THEN id END"}
        return ordered.running_sums(sliced, ["user_id"], ["date", "id"], "_slice", sums, totals={"all": "s"}).drop("_slice")

    both(monkeypatch, make)


def test_sums_inside_of_small_keys(rows, monkeypatch):
    spans = rows.where("date IS NOT NULL").selectExpr("id AS session_id", "user_id", "date AS start_time", "date + INTERVAL 9 HOURS AS end_time")
    both(monkeypatch, lambda: intervals.sums_inside(spans.where("session_id % 5 = 0"), rows, "user_id", {"n": "1", "s": "id"}))


def test_error_windows_of_small_keys(rows, monkeypatch):
    errors = rows.selectExpr("id AS session_id", "user_id", "date AS start_time", "CAST(id AS DOUBLE) AS row_error")
    both(monkeypatch, lambda: scoring.masked_error_window(errors, length=4))


def test_larger_keys_keep_their_slices(rows, monkeypatch):
    monkeypatch.setattr(ordered, "LEAST_ROW_BYTES", 0)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 400)  # a key may have 50 rows and stay whole; these have about 100
    assert ordered.time_slices(rows, ["user_id"], "date", 3600).select("_slice").distinct().count() > 100


def test_step_totals(spark):
    random.seed(4)
    made = [(i, [[random.random() for _ in range(3)] for _ in range(5)]) for i in range(30)]
    df = spark.createDataFrame(made, "id int, seq array<array<double>>").repartition(4)
    got = {r["id"]: r["t"] for r in df.select("id", label_queries._step_totals(5, 3)(F.col("seq")).alias("t")).collect()}
    for i, seq in made:
        for f in range(3):
            total = 0.0
            for step, vector in enumerate(seq):
                total += (step + 1) * vector[f]
            assert got[i][f] == total
    empty = df.where("id < 0").select(label_queries._step_totals(5, 3)(F.col("seq")))
    assert empty.collect() == []


def test_details_label_sessions_once(spark, rows, monkeypatch):
    calls = []

    def labelled(s, d):
        calls.append(d)
        return rows.selectExpr("id AS session_id", "user_id", "date AS start_time", "CAST(id AS DOUBLE) AS duration_minutes", "0 AS label_user", "0 AS label_session")

    monkeypatch.setattr(metric_queries, "labelled", labelled)
    assert metric_queries.QUERIES["session_details"](spark, "x").count() == 400 and calls == ["x"]
