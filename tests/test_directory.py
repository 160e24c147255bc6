from checking import table

from sentrace.operators import directory as D

SNAPSHOTS = "user_id string, ldap_month string, role string, department string"


def test_changes(spark):
    rows = [
        ("a", "2023-12", "Engineer", "D1"),
        ("a", "2024-01", "Manager", "D1"),
        ("a", "2024-02", None, "D2"),
        ("a", "2024-03", "Manager", "D2"),
        ("b", "2024-01", "Nurse", "D1"),
    ]
    history = D.snapshot_changes(spark.createDataFrame(rows, SNAPSHOTS))
    got = {(r["user_id"], r["ldap_month"]): r for r in history.collect()}
    flags = {k: (r["prev_role"], r["role_changed"], r["dept_changed"]) for k, r in got.items()}
    assert flags == {
        ("a", "2023-12"): (None, False, False),
        ("a", "2024-01"): ("Engineer", True, False),
        ("a", "2024-02"): ("Manager", True, True),
        ("a", "2024-03"): (None, False, False),
        ("b", "2024-01"): (None, False, False),
    }
    assert got["b", "2024-01"]["is_terminated"] and not got["a", "2023-12"]["is_terminated"]
    latest = {r["user_id"]: r["ldap_month"] for r in D.snapshot_latest(history).collect()}
    assert latest == {"a": "2024-03", "b": "2024-01"}


def test_enrichment(spark):
    history = D.snapshot_changes(
        spark.createDataFrame([("a", "2024-01", "ITAdmin", "D1"), ("a", "2024-02", "Nurse", "D1")], SNAPSHOTS)
    )
    features = table(
        spark,
        [("s1", "a", "2024-01-31 23:59"), ("s2", "a", "2024-02-01 00:00"), ("s3", "a", "2024-03-01 00:00"), ("s4", "x", "2024-01-01 00:00")],
        "session_id string, user_id string, start_time ntz",
    )
    got = {r["session_id"]: r for r in D.enrich_directory(features, history).collect()}
    assert [(got[s]["role"], got[s]["is_admin"], got[s]["role_changed_this_month"]) for s in ("s1", "s2", "s3", "s4")] == [
        ("ITAdmin", 1, False),
        ("Nurse", 0, True),
        (None, 0, False),
        (None, 0, False),
    ]
    last = {r["session_id"]: r["role"] for r in D.enrich_directory_latest(features, D.snapshot_latest(history)).collect()}
    assert last == {"s1": "Nurse", "s2": "Nurse", "s3": "Nurse", "s4": None}
