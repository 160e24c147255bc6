import numpy as np
import pytest

from sentrace.operators import features as X
from sentrace.sources.roles import RoleMap, role_map
from sentrace.storage import scratch_path


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = [
        (i, float(rng.lognormal()), int(rng.integers(0, 9)), 4, bool(rng.integers(0, 2)), None, str(rng.choice(["A", "B", "C"])))
        for i in range(301)
    ]
    rows += [(900, None, 1, 4, None, None, None), (901, float("nan"), 2, 4, True, None, " A ")]
    schema = "session_id int, duration_minutes double, total_actions int, start_hour int, user_terminated boolean, openness int, role string"
    return spark.createDataFrame(rows, schema)


NAMES = ["duration_minutes", "total_actions", "start_hour", "absent"]


def test_fit_equals_numpy(frame):
    model = X.fit_features(frame, NAMES, clip_percentile=99)
    assert model.names == ["duration_minutes", "total_actions", "start_hour", "user_terminated", "openness"]
    pdf = frame.toPandas()
    by_name = {r["feature"]: r for r in model.rows}
    x = pdf["duration_minutes"]
    median = np.nanmedian(x)
    filled = x.fillna(median)
    row = by_name["duration_minutes"]
    assert row["median"] == pytest.approx(median)
    assert [row["q1"], row["q3"]] == pytest.approx(list(np.percentile(filled, [25, 75])))
    scaled = (filled - median) / (row["q3"] - row["q1"])
    assert [row["lo"], row["hi"]] == pytest.approx(list(np.percentile(scaled, [1, 99])))
    assert by_name["openness"]["median"] == 0.0
    assert by_name["start_hour"]["q1"] == by_name["start_hour"]["q3"] == 4.0


def test_transform(frame):
    model = X.fit_features(frame, NAMES)
    rows = {r["session_id"]: r for r in X.feature_vector(frame, model).collect()}
    row = {r["feature"]: r for r in model.rows}
    assert rows[900]["features"][0] == 0.0 and rows[901]["features"][0] == 0.0
    assert {r["features"][2] for r in rows.values()} == {0.0}
    first = row["duration_minutes"]
    assert rows[0]["features"][0] == pytest.approx(
        (rows[0]["duration_minutes"] - first["median"]) / (first["q3"] - first["q1"])
    )
    scaled = sorted(r["features"][0] for r in rows.values())
    assert scaled[len(scaled) // 2] == 0.0


def test_clip_is_applied(frame):
    model = X.fit_features(frame, ["duration_minutes"], optional=False, clip_percentile=95)
    values = [r["duration_minutes"] for r in X.clip_scaled(frame, model).collect()]
    assert max(values) == pytest.approx(model.rows[0]["hi"]) and min(values) == pytest.approx(model.rows[0]["lo"])


def test_roles(frame):
    model = X.fit_features(frame, NAMES, role_mode="roles", categories=["C", "A", "B"])
    assert model.names[-3:] == ["role_A", "role_B", "role_C"]
    rows = {r["session_id"]: r for r in X.encode_roles(frame, model).collect()}
    assert rows[900]["role_vector"] == [0.0, 0.0, 0.0] and sum(rows[0]["role_vector"]) == 1.0
    units = RoleMap(["U1", "U2"], {"A": "U1", "B": "U1"}, None)
    by_unit = X.fit_features(frame, NAMES, role_mode="units", role_map=units)
    got = {r["role"]: r["role_vector"] for r in X.encode_roles(frame, by_unit).collect()}
    assert got == {"A": [1.0, 0.0], "B": [1.0, 0.0], "C": [0.0, 0.0], " A ": [1.0, 0.0], None: [0.0, 0.0]}
    with_default = X.fit_features(frame, NAMES, role_mode="units", role_map=RoleMap(["U1", "U2"], {"A": "U1"}, "U2"))
    got = {r["role"]: r["role_vector"] for r in X.encode_roles(frame, with_default).collect()}
    assert got["C"] == [0.0, 1.0] and got[None] == [0.0, 0.0]


def test_save_and_load(spark, frame):
    model = X.fit_features(frame, NAMES, role_mode="units", role_map=role_map(), clip_percentile=99)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    again = X.FeatureModel.load(spark, path)
    assert again == model
    left = X.feature_vector(frame, model).select("session_id", "features").collect()
    assert sorted(left) == sorted(X.feature_vector(frame, again).select("session_id", "features").collect())


def test_errors(spark, frame):
    with pytest.raises(ValueError):
        X.fit_features(frame.select("session_id"))
    with pytest.raises(ValueError):
        X.fit_features(frame, role_mode="unit")
    with pytest.raises(ValueError):
        X.fit_features(frame, role_mode="units")
    with pytest.raises(ValueError):
        role_map({})
    with pytest.raises(ValueError):
        role_map({"A": ["x"]})
    assert role_map({"unit_order": ["A", "B"], "A": "x"}).role_to_unit == {"x": "A"}
