"""Compression, reconstruction error and scored output."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrace.operators import features as X
from sentrace.operators import scoring as K
from sentrace.operators.sequences import sequences
from sentrace.plans import adapters as A
from sentrace.plans.base import stored
from sentrace.plans.feature_queries import ALL_FEATURES, LENGTH, SCALED, fitted_views
from sentrace.plans.metric_queries import _rounded
from sentrace.storage import materialise, scratch_path

K_SESSION = 8
K_EMBEDDING = 16
WINDOW = 100
PROJECTED = 5000


def _vectors(s, d):
    rows = stored(s, d, "enriched")
    model = X.fit_features(rows)
    kept = X.feature_vector(rows, model).select("session_id", "user_id", "start_time", "features")
    return materialise(kept, "vectors"), model


def _session_error(operator):
    def run(s, d):
        rows, model = _vectors(s, d)
        compressor = K.fit_compressor(rows, K_SESSION)
        options = {"pad": model.padding} if operator is K.reconstruction_error_all else {}
        return operator(rows, compressor, WINDOW, **options).drop("features")

    return run


def _components(s, d):
    vectors = A.table(s, d, "embeddings")
    model = K.fit_compressor(vectors, K_EMBEDDING, "embedding")
    rows = [(c, p, w) for c, row in enumerate(model.components) for p, w in enumerate(row)]
    components = s.createDataFrame(rows, "component int, position int, weight double")
    share = K.embed_sessions(vectors.withColumnRenamed("embedding", "v"), model, "v")
    spread = (
        share.selectExpr("posexplode(embedding) AS (component, x)")
        .groupBy("component")
        .agg(F.expr("var_samp(x) AS variance"))
    )
    return components.join(spread, "component")


def _embedded(s, d):
    vectors = A.table(s, d, "embeddings").withColumnRenamed("embedding", "v")
    return K.embed_sessions(vectors, K.fit_compressor(vectors, K_EMBEDDING, "v"), "v").drop("v")


def _attribution(s, d):
    rows, model = _vectors(s, d)
    return K.feature_attribution(rows, K.fit_compressor(rows, K_SESSION), model.names)


def _detail(s, d):
    rows, model = _vectors(s, d)
    last = rows.orderBy(F.desc("start_time"), F.desc("session_id")).first()["session_id"]
    return K.sequence_error_detail(rows, K.fit_compressor(rows, K_SESSION), model.names, last, WINDOW)


def _scored(s, d):
    rows, _ = _vectors(s, d)
    return K.score_sessions(rows, K.fit_compressor(rows, K_SESSION), length=WINDOW)


def _scored_one(s, d):
    """The longest session, as if it were new, against the errors of all sessions."""
    rows = stored(s, d, "enriched")
    feature_model = X.fit_features(rows)
    vectors = X.feature_vector(rows, feature_model).select("session_id", "user_id", "start_time", "features")
    compressor = K.fit_compressor(vectors, K_SESSION)
    reference = K.reconstruction_error(vectors, compressor, WINDOW).selectExpr("error AS reconstruction_error")
    longest = rows.orderBy(F.desc("duration_minutes"), "session_id").first()["session_id"]
    new = F.col("session_id") == longest
    return K.score_session(
        rows.where(~new), feature_model, compressor, longest, current=rows.where(new), reference=reference,
        length=WINDOW,
    )


def _squared_norm_model():
    """A stand-in for a trained network: embedding = last step, error = mean squared norm."""
    import numpy as np

    def predict(seq, mask):
        norms = (np.square(seq).sum(axis=2) * mask).sum(axis=1) / mask.sum(axis=1)
        return {"embedding": seq[:, -1, :], "error": norms}

    return predict


def _external(s, d):
    rows = stored(s, d, "enriched")
    model = X.fit_features(rows)
    built = materialise(sequences(X.feature_vector(rows, model), LENGTH, model.padding), "sequences")
    scored = K.score_sessions(built, K.batch_model(_squared_norm_model, LENGTH, len(model.names)))
    return scored.selectExpr(
        "session_id",
        "user_id",
        "timestamp",
        "round(reconstruction_error, 6) AS reconstruction_error",
        "round(anomaly_percentile, 6) AS anomaly_percentile",
    )


def _written(s, d):
    from sentrace.sources.tables import write_scores

    scores = _rounded(_windowed(s, d), "error")
    json_path, csv_path = scratch_path(s, "scores-json"), scratch_path(s, "scores-csv")
    write_scores(scores, json_path, "json")
    write_scores(scores.withColumn("embedding", F.array("error")), csv_path, "csv")
    schema = "event_id bigint, user_id bigint, error double"
    from_json = s.read.schema(schema).json(json_path)
    from_csv = s.read.schema(schema).csv(csv_path, header=True)
    return from_json.withColumn("fmt", F.lit("json")).unionByName(from_csv.withColumn("fmt", F.lit("csv")))


def _windowed(s, d):
    events = A.table(s, d, "events").select("event_id", "user_id", "ts", F.col("value").alias("row_error"))
    return K.masked_error_window(events, "row_error", WINDOW, time="ts", tie="event_id").select(
        "event_id", "user_id", "error"
    )


QUERIES = {
    "fit_compressor": _components,
    "embed_sessions": _embedded,
    "embedding_2d": lambda s, d: K.embedding_2d(A.table(s, d, "embeddings"), PROJECTED),
    "masked_error_window": lambda s, d: _rounded(_windowed(s, d), "error"),
    "reconstruction_error": _session_error(K.reconstruction_error),
    "reconstruction_error_all": _session_error(K.reconstruction_error_all),
    "feature_attribution": _attribution,
    "sequence_error_detail": _detail,
    "score_sessions": _scored,
    "score_session": _scored_one,
    "score_sessions_external": _external,
    "write_scores": _written,
}

_WINDOWED = f"""SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 9) AS error FROM events"""
_NAMES = ", ".join(f"'{f}'" for f in ALL_FEATURES)

ORACLE = {
    "masked_error_window": _WINDOWED,
    "write_scores": f"""SELECT w.*, fmt FROM ({_WINDOWED}) w, (SELECT unnest(['json', 'csv']) AS fmt)""",
    "score_sessions_external": fitted_views(
        f"""SELECT session_id, user_id, strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
            round(error, 6) AS reconstruction_error,
            round(100.0 * (rank() OVER (ORDER BY round(error, 9)) - 1) / CAST(count(*) OVER () AS DOUBLE), 6)
                AS anomaly_percentile
            FROM (SELECT e.session_id, e.user_id, e.start_time, avg(norm) OVER (PARTITION BY e.user_id
                ORDER BY e.start_time, e.session_id ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS error
                FROM enriched e JOIN (SELECT session_id, sum({SCALED} * {SCALED}) AS norm
                    FROM long JOIN fitted USING (feature) WHERE feature IN ({_NAMES}) GROUP BY session_id) n
                    USING (session_id))"""
    ),
}
