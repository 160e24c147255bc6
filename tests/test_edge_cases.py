"""NULL keys and scores, overlapping sessions, equal incidents, odd files and names."""

import numpy as np
import pytest
from checking import table

from sentrace.operators import features as X
from sentrace.operators import metrics as M
from sentrace.operators import profile, scoring
from sentrace.operators import sessions as S
from sentrace.plans import base
from sentrace.sources import logs, tables
from sentrace.storage import clean, materialise, shared_dir

SESSION = "session_id string, user_id string, pc string, start_time ntz, end_time ntz"
DEVICE = "id string, date ntz, user_id string, activity string"
HTTP = "id string, date ntz, user_id string, url string"


def test_null_user_and_machine_match_nothing(spark):
    sessions = table(
        spark,
        [("a", None, "p", "2024-01-01 09:00", "2024-01-01 10:00"), ("b", "u", None, "2024-01-01 09:00", "2024-01-01 10:00")],
        SESSION,
    )
    device = table(spark, [("1", "2024-01-01 09:30", None, "Connect"), ("2", "2024-01-01 09:30", "u", "Connect")], DEVICE)
    counts = {r["session_id"]: r["device_event_count"] for r in S.session_device(sessions, device).collect()}
    assert counts == {"a": 0, "b": 1}
    assert [r["session_id"] for r in S.events_in_session(sessions, device).collect()] == ["b"]
    with_pc = device.selectExpr("*", "CAST(NULL AS STRING) AS pc")
    assert S.events_in_session(sessions, with_pc, match_pc=True).count() == 0
    http = table(spark, [("1", "2024-01-01 09:30", None, "http://x.example/")], HTTP)
    assert {r["unique_domains"] for r in S.session_http(sessions, http).collect()} == {0}


def test_overlapping_sessions_of_one_machine_all_get_their_events(spark):
    sessions = table(
        spark,
        [("a", "u", "p", "2024-01-01 09:00", "2024-01-01 17:00"), ("b", "u", "p", "2024-01-01 12:00", "2024-01-01 13:00")],
        SESSION,
    )
    http = table(
        spark, [("1", "2024-01-01 12:30", "u", "http://x.example/"), ("2", "2024-01-01 14:00", "u", "http://y.example/")], HTTP
    )
    pairs = sorted((r["session_id"], r["id"]) for r in S.events_in_session(sessions, http).collect())
    assert pairs == [("a", "1"), ("a", "2"), ("b", "1")]
    got = {r["session_id"]: (r["http_request_count"], r["unique_domains"]) for r in S.session_http(sessions, http).collect()}
    assert got == {"a": (2, 2), "b": (1, 1)}


def test_a_hot_user_on_many_machines_gives_only_real_pairs(spark):
    sessions = spark.range(500).selectExpr(
        "CAST(id AS STRING) AS session_id", "'u' AS user_id", "concat('p', id) AS pc",
        "TIMESTAMP_NTZ'2024-01-01 09:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS start_time",
        "TIMESTAMP_NTZ'2024-01-01 09:00:01' + make_interval(0, 0, 0, 0, 0, 0, id) AS end_time",
    )
    events = spark.range(5000).selectExpr(
        "CAST(id AS STRING) AS id", "'u' AS user_id", "TIMESTAMP_NTZ'2024-01-01 09:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 10) AS date"
    )
    assert S.events_in_session(sessions, events).count() == 5000


def test_incidents_with_equal_windows_are_each_counted(spark):
    incident = ("u", "2024-01-01 00:00", "2024-01-02 00:00")
    incidents = table(spark, [incident, incident], "user_id string, inc_start ntz, inc_end ntz")
    scored = table(
        spark,
        [("s1", "u", "2024-01-01 01:00", 0.0), ("s2", "u", "2024-01-01 02:00", 9.0)],
        "session_id string, user_id string, start_time ntz, score double",
    )
    rows = M.ttd_per_incident(scored, incidents, 5.0).collect()
    assert [(r["total_sessions"], r["sessions_to_detect"], r["detected"]) for r in rows] == [(2, 1, True)] * 2
    total = M.time_to_detect(scored, incidents, 5.0).first()
    assert (total["n_detected"], total["n_total"]) == (2, 2)


def test_null_and_nan_scores_are_in_no_percentile(spark):
    scores = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, float("nan"))], "id int, score double")
    got = {r["id"]: r["pct"] for r in M.anomaly_percentile(scores).collect()}
    assert got == {1: 0.0, 2: 50.0, 3: None, 4: None}
    got = {r["id"]: r["pct"] for r in M.percentile_vs_reference(scores, scores).collect()}
    assert got == {1: 0.0, 2: 50.0, 3: None, 4: None}


def test_row_error_keeps_small_errors_beside_large_values(spark):
    random = np.random.default_rng(0)
    rows = random.standard_normal((200, 5)) * [1, 2, 1, 1e9, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, features array<double>")
    model = scoring.fit_compressor(df, 1)
    got = np.array([r["row_error"] for r in scoring.row_errors(df, model).orderBy("id").collect()])
    parts, mean = np.array(model.components), np.array(model.mean)
    rest = (rows - mean) - (rows - mean) @ parts.T @ parts
    assert np.allclose(got, (rest**2).sum(1), rtol=1e-9) and (got > 0).all()


def test_many_roles_are_encoded(spark):
    n = 10_050
    df = spark.range(n).selectExpr("concat('r''', id) AS role", "1.0D AS duration_minutes").unionByName(
        spark.createDataFrame([(None, 1.0), ("other", 1.0)], "role string, duration_minutes double")
    )
    model = X.fit_features(df.where("role != 'other'"), ["duration_minutes"], optional=False, role_mode="roles")
    assert len(model.categories) == n
    asked = df.where("role IN ('r''7', 'other') OR role IS NULL")
    got = {r["role"]: (sum(r["role_vector"]), r["role_vector"].index(1.0) if sum(r["role_vector"]) else None) for r in X.encode_roles(asked, model).collect()}
    assert got == {"r'7": (1.0, model.categories.index("r'7")), "other": (0.0, None), None: (0.0, None)}


def test_absent_features_are_told(spark):
    with pytest.warns(UserWarning, match="misspelt"):
        assert X.present_features(["duration_minutes"], ["duration_minutes", "misspelt"]) == ["duration_minutes"]


def test_all_numeric_columns_are_profiled(spark):
    df = spark.range(3).selectExpr("id", *[f"id + {i} AS `n'{i}`" for i in range(12)])
    got = profile.profile_table(df, "it's").where("metric = 'max'")
    assert got.count() == 13 and got.where("table = \"it's\" AND column = \"n'11\"").first()["value"] == 13.0
    assert profile.profile_nulls(df).count() == 13


def test_line_breaks_in_quoted_fields_are_ingested(spark, tmp_path):
    text = 'id,date,user,pc,activity\n"1",01/02/2010 06:49:00,"u\n1",p,Logon\n2,01/02/2010 07:00:00,u2,p,Logoff\n'
    (tmp_path / "logon.csv").write_text(text)
    with pytest.warns(UserWarning):
        stats = {r["table"]: r["rows"] for r in tables.ingest(spark, str(tmp_path), f"{tmp_path}/out").collect()}
    assert stats == {"logon": 2}
    assert {r["user_id"] for r in spark.read.parquet(f"{tmp_path}/out/logon.parquet").collect()} == {"u\n1", "u2"}


def test_snapshot_months_with_other_columns(spark, tmp_path):
    (tmp_path / "2010-01.csv").write_text("employee_name,user_id,role,department\nA,u1,Admin,D1\n")
    (tmp_path / "2010-02.csv").write_text("user_id,employee_name,team,role\nu1,A,T1,Boss\n")
    got = {r["ldap_month"]: (r["user_id"], r["role"], r["department"], r["team"]) for r in logs.scan_snapshots(spark, str(tmp_path)).collect()}
    assert got == {"2010-01": ("u1", "Admin", "D1", None), "2010-02": ("u1", "Boss", None, "T1")}


def test_stored_steps_follow_their_inputs(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    customer = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    source.write.parquet(f"{tmp_path}/events.parquet")
    before = base.stored(spark, str(tmp_path), "sessions").count()
    materialise(source.where("event_type != 'signup'"), "events").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert before > 0 and base.stored(spark, str(tmp_path), "sessions").count() == 0


def test_clean_removes_what_was_stored(spark):
    session = spark.newSession()
    import os

    own = materialise(session.range(3), "kept").inputFiles()[0].removeprefix("file://")
    assert shared_dir(session) in own and os.path.exists(own)
    base.forget()
    clean(session)
    assert not os.path.exists(own)
