import datetime as dt
import os
import tempfile

import pytest

from sentrace.operators import profile
from sentrace.sources import logs, roles, tables, truth


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)
    return path


def test_quotes_commas_and_line_breaks(spark, folder):
    path = write(
        f"{folder}/http.csv",
        'id,date,user,pc,url,content\n1,01/02/2010 06:00:00,u,PC-1,http://a.b/c,"say ""hi"", you"\n'
        '2,bad,u,PC-1,,"two\nlines"\n',
    )
    raw = logs.scan_log(spark, path, "http", multi_line=True)
    assert {f.dataType.simpleString() for f in raw.schema.fields} == {"string"}
    rows = {r["id"]: r for r in logs.typed_log(raw, "http").collect()}
    assert rows["1"]["content"] == 'say "hi", you' and rows["2"]["content"] == "two\nlines"
    assert rows["1"]["date"] == dt.datetime(2010, 1, 2, 6) and rows["2"]["date"] is None
    assert rows["2"]["url"] is None
    with pytest.raises(ValueError):
        logs.scan_log(spark, path, "other")


def test_header_order_decides(spark, folder):
    path = write(f"{folder}/logon.csv", "activity,id,pc,user,date\nLogon,9,P,u,2010-01-02 06:00:00\n")
    row = logs.typed_log(logs.scan_log(spark, path, "logon"), "logon").first()
    assert (row["id"], row["user_id"], row["activity"]) == ("9", "u", "Logon")


def test_numbers(spark):
    texts = ["3", " 4 ", "3.7", "-3.7", "x", None, "NaN", "1e3", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "size string")
    got = [r["size"] for r in logs.coerce_types(df, ints=["size"]).collect()]
    assert got[:8] == [3, 4, 3, -3, 0, 0, 0, 1000]


def test_times(spark):
    texts = ["2010-01-02", "2010-01-02T03:04:05", "1/2/2010 3:04", "01/02/2010 03:04:05", "13/13/2010", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    day = dt.datetime(2010, 1, 2)
    hour = dt.datetime(2010, 1, 2, 3, 4, 5)
    got = [r["t"] for r in logs.coerce_types(df, timestamps=["t"]).collect()]
    assert got == [day, hour, hour.replace(second=0), hour, None, None, None]


def test_ingest(spark, folder):
    write(f"{folder}/logon.csv", "id,date,user,pc,activity\n1,01/02/2010 06:00:00,u,P,Logon\n2,x,u,P,Logoff\n")
    write(f"{folder}/psychometric.csv", "employee_name,user_id,O,C,E,A,N\nN,u,1,2,x,4,5\n")
    head = "employee_name,user_id,email,role,business_unit,functional_unit,department,team,supervisor\n"
    write(f"{folder}/LDAP/2010-01.csv", head + "N,u,e,Nurse,1,f,d,t,s\nM,v,e,Nurse,1,f,d,t,s\n")
    write(f"{folder}/LDAP/2010-02.csv", head + "N,u,e,Manager,1,f,d,t,s\n")
    with pytest.warns(UserWarning):
        stats = tables.ingest(spark, folder, f"{folder}/out")
    assert {r["table"]: r["rows"] for r in stats.collect()} == {"logon": 2, "psychometric": 1, "ldap": 3}
    stored = tables.scan_parquet(spark, f"{folder}/out/logon.parquet", "stored_logon")
    assert stored.count() == 2 and spark.table("stored_logon").where("day = DATE'2010-01-02'").count() == 1
    traits = spark.read.parquet(f"{folder}/out/psychometric.parquet").first()
    assert (traits["o"], traits["e"]) == (1, 0)
    latest = {r["user_id"]: (r["role"], r["is_terminated"]) for r in spark.read.parquet(f"{folder}/out/ldap.parquet").collect()}
    assert latest == {"u": ("Manager", False), "v": ("Nurse", True)}
    history = spark.read.parquet(f"{folder}/out/ldap_history.parquet")
    assert {r["ldap_date"] for r in history.collect()} == {dt.datetime(2010, 1, 1), dt.datetime(2010, 2, 1)}


def test_truth(spark, folder):
    path = write(
        f"{folder}/insiders.csv",
        "dataset,scenario,details,user,start,end\n4.2,1,a.csv,u,01/02/2010 06:00:00,01/03/2010 06:00:00\n"
        "4.2,2,b.csv,v,soon,01/03/2010 06:00:00\n3.1,1,c.csv,w,01/02/2010 06:00:00,01/03/2010 06:00:00\n",
    )
    got = {r["user_id"]: r for r in truth.incidents(spark, path).collect()}
    assert set(got) == {"u", "v"}
    assert got["u"]["inc_end"] == dt.datetime(2010, 1, 3, 6) and got["v"]["inc_end"] is None
    write(f"{folder}/r4.2-1/x.csv", "logon,{1},01/02/2010 06:00:00,u,PC,Logon\nshort,1\nhttp,{2},never,u,PC,a,b\n")
    write(f"{folder}/r4.2-2/y.csv", 'http,{3},01/02/2010 07:00:00,v,PC,http://x,"a,b"\n')
    for n in (3,):
        os.makedirs(f"{folder}/r4.2-{n}")
    rows = truth.malicious_events(spark, truth.malicious_event_folders(folder)).collect()
    assert {(r["user_id"], r["ts"].hour, r["event_type"], r["file"]) for r in rows} == {
        ("u", 6, "logon", "x.csv"),
        ("v", 7, "http", "y.csv"),
    }


def test_role_files(spark, folder):
    path = write(f"{folder}/roles.yaml", "unit_order: [A, B]\nA: [x, ' y ']\nB: z\ndefault_unit: B\n")
    known = roles.load_role_map(path)
    assert known.role_to_unit == {"x": "A", "y": "A", "z": "B"} and known.default_unit == "B"
    assert {tuple(r) for r in roles.role_units(spark, known).collect()} == {("x", "A", 0), ("y", "A", 0), ("z", "B", 1)}
    as_json = write(f"{folder}/roles.json", '{"unit_order": ["A"], "A": ["q"]}')
    assert roles.load_role_map(as_json).role_to_unit == {"q": "A"}
    with pytest.raises(ValueError):
        roles.load_role_map(write(f"{folder}/empty.json", "{}"))
    assert len(roles.role_map().role_to_unit) == 42


def test_cache_builds_once(spark, folder):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert tables.prepared_cache(spark, config, build, folder).count() == 3
    assert len(built) == 2


def test_score_files(spark, folder):
    df = spark.createDataFrame([("s", [1.0], 0.5)], "session_id string, embedding array<float>, error double")
    for fmt in ("json", "parquet", "csv"):
        tables.write_scores(df, f"{folder}/{fmt}", fmt)
    assert spark.read.csv(f"{folder}/csv", header=True).columns == ["session_id", "error"]
    assert spark.read.json(f"{folder}/json").first()["embedding"] == [1.0]
    with pytest.raises(ValueError):
        tables.write_scores(df, folder, "xml")


def test_checks(spark, folder):
    logon = spark.createDataFrame([(1,), (1,)], "id int")
    sessions = spark.createDataFrame([(-1.0,)], "duration_minutes double")
    rows = profile.validate({"logon": logon, "sessions": sessions, "http": logon.limit(0)}, ["logon", "email"]).collect()
    assert {(r["check"], r["table"], r["value"], r["passed"]) for r in rows} == {
        ("missing", "email", 1, False),
        ("empty", "logon", 2, True),
        ("duplicate_ids", "logon", 1, False),
        ("empty", "sessions", 1, True),
        ("negative_duration", "sessions", 1, False),
        ("empty", "http", 0, False),
    }
    raw = spark.createDataFrame([("a", 10), ("b", 0)], "table string, rows bigint")
    new = spark.createDataFrame([("a", 4)], "table string, rows bigint")
    assert {tuple(r) for r in profile.retention(raw, new).collect()} == {("a", 10, 4, 40.0), ("b", 0, 0, None)}


def test_current_session_is_added_once(spark):
    rows = spark.createDataFrame([("s1", "u"), ("s2", "v")], "session_id string, user_id string")
    new = spark.createDataFrame([("s9", "u")], "session_id string, user_id string")
    assert profile.user_history(rows, session_id="s1", current=new).count() == 2
    assert profile.user_history(rows, user_id="u", current=rows.where("session_id = 's1'")).count() == 1
    with pytest.raises(ValueError):
        profile.user_history(rows, session_id="none")
