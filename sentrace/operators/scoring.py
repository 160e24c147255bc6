"""Reconstruction-error scores from a linear autoencoder, or from a model of the user.

The autoencoder keeps the first k principal components of the centred training vectors;
a vector is rebuilt from its k coordinates and the squared difference is its error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrace.functions.columns import text_literal
from sentrace.operators.features import FeatureModel, feature_vector
from sentrace.operators.intervals import DAY
from sentrace.operators.labels import sample_sessions
from sentrace.operators.metrics import anomaly_percentile, percentile_vs_reference
from sentrace.operators.ordered import time_slices, trailing
from sentrace.operators.profile import user_history
from sentrace.storage import materialise


@dataclass
class Compressor:
    """Mean, components and the Spark PCA model; their size depends on the vector length only."""

    mean: list[float]
    pca: PCAModel

    @property
    def components(self) -> list[list[float]]:
        """k orthonormal rows of vector length."""
        return self.pca.pc.toArray().T.astype(float).tolist()

    @property
    def mean_code(self) -> list[float]:
        return [sum(c * m for c, m in zip(row, self.mean)) for row in self.components]

    def save(self, spark: SparkSession, path: str) -> None:
        self.pca.write().overwrite().save(f"{path}/pca")
        means = spark.createDataFrame([(self.mean,)], "mean array<double>")
        means.coalesce(1).write.mode("overwrite").parquet(f"{path}/mean")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Compressor:
        return cls(list(spark.read.parquet(f"{path}/mean").first()["mean"]), PCAModel.load(f"{path}/pca"))


def fit_compressor(df: DataFrame, k: int, vector: str = "features") -> Compressor:
    """Principal components of the vectors; the Gram matrix is summed on the executors."""
    vectors = df.select(array_to_vector(F.col(vector)).alias("_vector"))
    mean = vectors.select(Summarizer.mean(F.col("_vector")).alias("m")).first()["m"].toArray()
    model = PCA(k=k, inputCol="_vector", outputCol="_projected").fit(vectors)
    return Compressor([float(x) for x in mean], model)


def _array(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _coded(df: DataFrame, model: Compressor, vector: str) -> DataFrame:
    """Adds ``_code``: coordinates of the centred vector. The projection does not centre."""
    projected = model.pca.transform(df.withColumn("_vector", array_to_vector(F.col(vector))))
    return projected.withColumn("_projected", vector_to_array("_projected")).selectExpr(
        *df.columns, f"zip_with(_projected, {_array(model.mean_code)}, (p, m) -> p - m) AS _code"
    )


def _rebuilt(df: DataFrame, model: Compressor, vector: str) -> DataFrame:
    """Adds ``_code`` and ``_rebuilt``, the vector made again from its coordinates."""
    components, mean = np.array(model.components), np.array(model.mean)

    @F.pandas_udf("array<double>")
    def rebuild(codes: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(codes.to_numpy()) @ components + mean))

    return _coded(df, model, vector).withColumn("_rebuilt", rebuild("_code"))


def embed_sessions(df: DataFrame, model: Compressor, vector: str = "features") -> DataFrame:
    """Adds ``embedding ARRAY<FLOAT>``."""
    return _coded(df, model, vector).selectExpr(*df.columns, "CAST(_code AS ARRAY<FLOAT>) AS embedding")


def _row_errors(model: Compressor, vector: str) -> Column:
    """Squared length of what the components leave of the centred vector."""
    components, mean = np.array(model.components), np.array(model.mean)

    @F.arrow_udf("double")
    def left(vectors: pa.Array) -> pa.Array:
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        centred = values.reshape(len(vectors), len(mean)) - mean
        rest = centred - (centred @ components.T) @ components
        return pa.array((rest * rest).sum(axis=1))

    return left(vector)


def row_errors(df: DataFrame, model: Compressor, vector: str = "features") -> DataFrame:
    """Adds ``row_error``: squared difference summed over the features of one row.

    The residual itself is squared; a difference of squared lengths would lose all digits
    of small errors beside large values.
    """
    return df.withColumn("row_error", _row_errors(model, vector))


def masked_error_window(
    df: DataFrame,
    row_error: str = "row_error",
    length: int = 100,
    *,
    keys: Sequence[str] = ("user_id",),
    time: str = "start_time",
    tie: str = "session_id",
    slice_seconds: int = DAY,
) -> DataFrame:
    """Adds ``error``: mean row error over the session and its ``length - 1`` predecessors.

    Equals the masked error of the padded sequence, without building the sequence.
    """
    rows = time_slices(df, keys, time, slice_seconds)
    return trailing(rows, list(keys), [time, tie], "_slice", length, {"error": f"avg({row_error})"}).drop("_slice")


def reconstruction_error(
    df: DataFrame, model: Compressor, length: int = 100, *, vector: str = "features", **order
) -> DataFrame:
    """Adds ``error``: squared differences over the real steps / number of real steps."""
    return masked_error_window(row_errors(df, model, vector), "row_error", length, **order).drop("row_error")


def _padding_error(model: Compressor, pad: Sequence[float]) -> float:
    components = np.array(model.components)
    centred = np.array(pad, float) - np.array(model.mean)
    rest = centred - (components @ centred) @ components
    return float(rest @ rest)


def reconstruction_error_all(
    df: DataFrame,
    model: Compressor,
    length: int = 100,
    *,
    pad: Sequence[float] | None = None,
    vector: str = "features",
    keys: Sequence[str] = ("user_id",),
    time: str = "start_time",
    tie: str = "session_id",
    slice_seconds: int = DAY,
) -> DataFrame:
    """Adds ``error``: mean over all steps and features of the padded sequence."""
    width = len(model.mean)
    padded = _padding_error(model, pad if pad is not None else [0.0] * width)
    rows = time_slices(row_errors(df, model, vector), keys, time, slice_seconds)
    sums = {"_sum": "sum(row_error)", "_real": "count(*)"}
    return trailing(rows, list(keys), [time, tie], "_slice", length, sums).selectExpr(
        *df.columns, f"(_sum + ({length} - _real) * {padded!r}D) / {length * width} AS error"
    )


def feature_attribution(
    df: DataFrame, model: Compressor, names: Sequence[str], top_n: int = 20, vector: str = "features"
) -> DataFrame:
    """(feature, importance): mean squared error per feature, the ``top_n`` largest."""
    labels = "array(" + ", ".join(map(text_literal, names)) + ")"
    squared = f"zip_with({vector}, _rebuilt, (a, b) -> (a - b) * (a - b))"
    return (
        _rebuilt(df.select(vector), model, vector)
        .selectExpr(f"posexplode({squared}) AS (pos, sq)")
        .groupBy("pos")
        .agg(F.expr("avg(sq) AS importance"))
        .selectExpr(f"element_at({labels}, pos + 1) AS feature", "importance")
        .orderBy(F.desc("importance"), "feature")
        .limit(top_n)
    )


def sequence_error_detail(
    df: DataFrame,
    model: Compressor,
    names: Sequence[str],
    session_id: object,
    length: int = 100,
    *,
    vector: str = "features",
    time: str = "start_time",
    tie: str = "session_id",
) -> DataFrame:
    """(step, feature, actual, rebuilt, sq_err) for the history that ends in one session."""
    found = df.where(F.col(tie) == F.lit(session_id)).select("user_id", time, tie).first()
    if found is None:
        raise ValueError(f"session {session_id!r} not found")
    until = F.lit(found[time]).cast("timestamp_ntz")
    past = df.where(F.col("user_id") == F.lit(found["user_id"])).where(
        (F.col(time) < until) | ((F.col(time) == until) & (F.col(tie) <= F.lit(found[tie])))
    )
    recent = past.orderBy(F.desc(time), F.desc(tie)).limit(length)
    steps = recent.selectExpr(vector, f"row_number() OVER (PARTITION BY 0 ORDER BY {time} DESC, {tie} DESC) AS _back")
    labels = "array(" + ", ".join(map(text_literal, names)) + ")"
    return (
        _rebuilt(steps, model, vector)
        .selectExpr(
            f"{length} - _back AS step",
            f"posexplode(zip_with({vector}, _rebuilt, (a, r) -> struct(a AS actual, r AS rebuilt))) AS (pos, cell)",
        )
        .selectExpr(
            "step",
            f"element_at({labels}, pos + 1) AS feature",
            "CAST(cell.actual AS DOUBLE) AS actual",
            "cell.rebuilt AS rebuilt",
            "pow(CAST(cell.actual AS DOUBLE) - cell.rebuilt, 2) AS sq_err",
        )
    )


def embedding_2d(
    df: DataFrame, n: int = 5000, seed: int = 42, *, vector: str = "embedding", id_col: str = "vec_id", label: str = "label"
) -> DataFrame:
    """(id, x, y, label): first two principal components of a random sample of ``n`` vectors."""
    sample = sample_sessions(df, n, seed, id_col=id_col)
    model = fit_compressor(sample, 2, vector)
    return _coded(sample, model, vector).selectExpr(id_col, "_code[0] AS x", "_code[1] AS y", label)


_PREDICTION = T.StructType(
    [
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("error", T.DoubleType()),
    ]
)


def batch_model(
    make_predict: Callable, length: int, width: int, batch_size: int = 64
) -> Callable:
    """Column function of (seq, mask) around a model of the user.

    ``make_predict`` runs once per Python worker and returns a function of two arrays,
    (n, length, width) and (n, length), that gives a dict with ``embedding`` (n, any) and
    ``error`` (n,).
    """
    udf = predict_batch_udf(
        make_predict,
        return_type=_PREDICTION,
        batch_size=batch_size,
        input_tensor_shapes=[[length, width], [length]],
    )
    return lambda seq, mask: udf(F.flatten(seq), mask)


def score_sessions(
    df: DataFrame,
    model: Compressor | Callable,
    *,
    length: int = 100,
    reference: DataFrame | None = None,
    vector: str = "features",
    time: str = "start_time",
) -> DataFrame:
    """Output rows: ids, ISO time, embedding, reconstruction error, anomaly percentile.

    ``model`` is a :class:`Compressor`, or a column function (see :func:`batch_model`) that
    takes ``seq`` and ``mask`` of ``sequences`` and returns a struct (embedding, error). The
    scored rows are stored before they are ranked, so nothing is scored twice. Percentiles are against ``reference`` (column
    ``reconstruction_error``), or against the scored rows themselves.
    """
    if isinstance(model, Compressor):
        coded = _coded(row_errors(df, model, vector), model, vector).selectExpr(
            "session_id", "user_id", time, "CAST(_code AS ARRAY<FLOAT>) AS embedding", "row_error"
        )
        scored = masked_error_window(coded, "row_error", length, time=time)
        rows = scored.selectExpr("session_id", "user_id", time, "embedding", "error AS reconstruction_error")
    else:
        rows = df.withColumn("_out", model(F.col("seq"), F.col("mask"))).selectExpr(
            "session_id",
            "user_id",
            time,
            "_out.embedding AS embedding",
            "CAST(_out.error AS DOUBLE) AS reconstruction_error",
        )
    rows = materialise(rows, "scored")
    if reference is None:
        ranked = anomaly_percentile(rows, "reconstruction_error")
    else:
        ranked = percentile_vs_reference(rows, reference, "reconstruction_error")
    return _output(ranked, time)


def _output(ranked: DataFrame, time: str) -> DataFrame:
    return ranked.selectExpr(
        "session_id",
        "user_id",
        f"date_format({time}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS timestamp",
        "embedding",
        "reconstruction_error",
        "pct AS anomaly_percentile",
    )


def score_session(
    features: DataFrame,
    feature_model: FeatureModel,
    model: Compressor,
    session_id: object,
    *,
    current: DataFrame | None = None,
    reference: DataFrame | None = None,
    length: int = 100,
    time: str = "start_time",
) -> DataFrame:
    """Output row of one session, from its user's history alone.

    ``current`` is the session itself when it is not in ``features`` yet. Models are fitted
    beforehand on all data; the percentile is against ``reference`` and 50 without one.
    """
    if current is None:
        history = user_history(features, session_id=session_id)
    else:
        history = user_history(features, user_id=current.select("user_id").first()["user_id"], current=current)
    coded = _coded(row_errors(feature_vector(history, feature_model), model), model, "features").selectExpr(
        "session_id", "user_id", time, "CAST(_code AS ARRAY<FLOAT>) AS embedding", "row_error"
    )
    scored = masked_error_window(coded, "row_error", length, time=time).withColumnRenamed(
        "error", "reconstruction_error"
    )
    one = scored.where(F.col("session_id") == F.lit(session_id))
    return _output(percentile_vs_reference(one, reference, "reconstruction_error"), time)
