import numpy as np
import pytest
from checking import table

from sentrace.operators import features as X
from sentrace.operators import scoring as K
from sentrace.operators.sequences import sequences
from sentrace.storage import scratch_path

WIDTH, LENGTH, KEPT = 5, 4, 2
PAD = [0.5, 0.0, -1.0, 0.0, 2.0]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    mix = rng.normal(size=(WIDTH, WIDTH))
    x = rng.normal(size=(60, WIDTH)) @ mix + 3
    rows = [(i, f"u{i % 3}", f"2024-01-{1 + i // 3:02d} 0{i % 3}:00", x[i].tolist()) for i in range(60)]
    df = table(spark, rows, "session_id int, user_id string, start_time ntz, features array<double>")
    return df.cache(), x


@pytest.fixture(scope="module")
def model(vectors):
    return K.fit_compressor(vectors[0], KEPT)


def numpy_parts(x):
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    basis = vt[:KEPT]
    return mean, basis


def rebuild(x, parts):
    mean, basis = parts
    return (x - mean) @ basis.T @ basis + mean


def histories(x):
    for user in range(3):
        own = [i for i in range(60) if i % 3 == user]
        for n, i in enumerate(own):
            yield i, own[max(0, n - LENGTH + 1) : n + 1]


def test_errors_equal_numpy(vectors, model):
    df, x = vectors
    parts = numpy_parts(x)
    row = ((x - rebuild(x, parts)) ** 2).sum(axis=1)
    pad = np.array([PAD])
    pad_error = ((pad - rebuild(pad, parts)) ** 2).sum()
    masked = {r["session_id"]: r["error"] for r in K.reconstruction_error(df, model, LENGTH).collect()}
    plain = {r["session_id"]: r["error"] for r in K.reconstruction_error_all(df, model, LENGTH, pad=PAD).collect()}
    for i, past in histories(x):
        assert masked[i] == pytest.approx(row[past].mean())
        want = (row[past].sum() + (LENGTH - len(past)) * pad_error) / (LENGTH * WIDTH)
        assert plain[i] == pytest.approx(want)


def test_embedding_and_attribution(spark, vectors, model):
    df, x = vectors
    mean, basis = numpy_parts(x)
    got = {r["session_id"]: r["embedding"] for r in K.embed_sessions(df, model).collect()}
    mine = np.array([got[i] for i in range(60)])
    assert np.abs(mine) == pytest.approx(np.abs((x - mean) @ basis.T), abs=1e-4)
    names = [f"f{i}" for i in range(WIDTH)]
    importance = ((x - rebuild(x, (mean, basis))) ** 2).mean(axis=0)
    top = K.feature_attribution(df, model, names, top_n=3).collect()
    order = np.argsort(-importance)[:3]
    assert [r["feature"] for r in top] == [names[i] for i in order]
    assert [r["importance"] for r in top] == pytest.approx(importance[order])
    detail = K.sequence_error_detail(df, model, names, 30, LENGTH).collect()
    assert len(detail) == LENGTH * WIDTH
    last = {r["feature"]: r for r in detail if r["step"] == LENGTH - 1}
    assert [last[n]["actual"] for n in names] == pytest.approx(x[30].tolist())
    assert [last[n]["rebuilt"] for n in names] == pytest.approx(rebuild(x, (mean, basis))[30].tolist())
    path = scratch_path(spark, "compressor")
    model.save(spark, path)
    again = K.Compressor.load(spark, path)
    assert again.mean == model.mean and again.components == model.components


def test_scores(spark, vectors, model):
    df, x = vectors
    rows = K.score_sessions(df, model, length=LENGTH).collect()
    errors = sorted(r["reconstruction_error"] for r in rows)
    by_id = {r["session_id"]: r for r in rows}
    assert by_id[4]["timestamp"] == "2024-01-02T01:00:00.000000"
    for r in rows:
        below = sum(e < r["reconstruction_error"] for e in errors)
        assert r["anomaly_percentile"] == pytest.approx(100 * below / 60)
    reference = spark.createDataFrame([(0.0,), (1e9,)], "reconstruction_error double")
    fixed = K.score_sessions(df, model, length=LENGTH, reference=reference).collect()
    assert {r["anomaly_percentile"] for r in fixed} == {50.0}


def test_one_session(spark, vectors):
    rows = vectors[0].selectExpr("session_id", "user_id", "start_time", "features[0] AS total_actions", "features[1] AS email_count")
    fitted = X.fit_features(rows, ["total_actions", "email_count"], optional=False)
    coded = X.feature_vector(rows, fitted)
    model = K.fit_compressor(coded, 1)
    everyone = {r["session_id"]: r["reconstruction_error"] for r in K.score_sessions(coded, model, length=LENGTH).collect()}
    stored_one = K.score_session(rows, fitted, model, 30, length=LENGTH).collect()
    assert [(r["session_id"], r["anomaly_percentile"]) for r in stored_one] == [(30, 50.0)]
    new = K.score_session(
        rows.where("session_id < 30"), fitted, model, 30, current=rows.where("session_id = 30"), length=LENGTH
    ).first()
    assert new["reconstruction_error"] == pytest.approx(everyone[30]) == stored_one[0]["reconstruction_error"]


def test_model_of_the_user(vectors):
    def make():
        import numpy as np

        def predict(seq, mask):
            return {"embedding": seq[:, -1, :2], "error": (seq * mask[:, :, None]).sum(axis=(1, 2))}

        return predict

    df, x = vectors
    built = sequences(df, LENGTH, PAD)
    rows = K.score_sessions(built, K.batch_model(make, LENGTH, WIDTH)).collect()
    got = {r["session_id"]: r for r in rows}
    for i, past in histories(x):
        assert got[i]["reconstruction_error"] == pytest.approx(x[past].sum())
        assert got[i]["embedding"] == pytest.approx(x[i][:2].tolist(), rel=1e-5)


def test_projection_keeps_labels(spark, vectors):
    df = vectors[0].selectExpr("session_id AS vec_id", "features AS embedding", "1 AS label")
    out = K.embedding_2d(df, 40)
    assert out.count() == 40 and out.columns == ["vec_id", "x", "y", "label"]
