"""Session labels from incident windows, splits, and prepared data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.functions.columns import time_bucket
from sentrace.operators.features import FeatureModel, feature_vector, fit_features, role_categories
from sentrace.operators.intervals import DAY, interval_slices
from sentrace.operators.ordered import hash_key, hash_slice, ordinal
from sentrace.operators.sequences import sequences
from sentrace.storage import materialise


def incident_pieces(incidents: DataFrame, slice_seconds: int = DAY) -> DataFrame:
    """Incident windows as disjoint closed pieces per user and time slice.

    A session start then meets at most one piece, so a left join keeps one row per session.
    """
    dated = incidents.where("inc_start IS NOT NULL AND inc_end IS NOT NULL AND inc_end >= inc_start")
    sliced = interval_slices(
        dated.select("user_id", "inc_start", "inc_end"), "inc_start", "inc_end", slice_seconds, closed=True
    )
    reach = """max(inc_end) OVER (PARTITION BY user_id, _slice ORDER BY inc_start, inc_end
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _reach"""
    opens = "CASE WHEN _reach IS NULL OR inc_start > _reach THEN 1 ELSE 0 END"
    island = f"""sum({opens}) OVER (PARTITION BY user_id, _slice ORDER BY inc_start, inc_end
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _island"""
    return (
        sliced.distinct()
        .selectExpr("*", reach)
        .selectExpr("*", island)
        .groupBy("user_id", "_slice", "_island")
        .agg(F.expr("min(inc_start) AS _from"), F.expr("max(inc_end) AS _to"))
        .drop("_island")
    )


def label_sessions(
    sessions: DataFrame, users: DataFrame, incidents: DataFrame | None = None, *, slice_seconds: int = DAY
) -> DataFrame:
    """Adds ``label_user``, ``label_session`` and ``label`` (= label_session).

    A session is labelled if its start lies in a closed incident window of its user, who
    must be listed in ``users``. Without any incident the user label is used for both.
    """
    listed = users.select("user_id").distinct().withColumn("_listed", F.lit(1))
    known = sessions.join(listed, "user_id", "left").selectExpr(*sessions.columns, "coalesce(_listed, 0) AS label_user")
    if incidents is None:
        return known.selectExpr("*", "label_user AS label_session", "label_user AS label")
    pieces = incident_pieces(incidents, slice_seconds).withColumnRenamed("user_id", "_user")
    match = f"""user_id = _user AND {time_bucket('start_time', slice_seconds)} = _slice
        AND start_time >= _from AND start_time <= _to"""
    flag = "CASE WHEN label_user = 1 AND (_from IS NOT NULL OR NOT _any) THEN 1 ELSE 0 END"
    return (
        known.join(pieces, F.expr(match), "left")
        .withColumn("_any", incidents.agg(F.expr("count(*) > 0")).scalar())
        .selectExpr(*known.columns, f"{flag} AS label_session", f"{flag} AS label")
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.expr("count(*) AS sessions"),
        F.expr("sum(label_user) AS user_positives"),
        F.expr("sum(label_session) AS session_positives"),
        F.expr("100D * sum(label_user) / count(*) AS user_pct"),
        F.expr("100D * sum(label_session) / count(*) AS session_pct"),
    )


def split_random(
    labelled: DataFrame, train: float = 0.7, val: float = 0.1, seed: int = 42, *, normal_only: bool = True
) -> DataFrame:
    """Adds ``split``: exact shares of the normal users' sessions, insiders all to test.

    The order is a hash of session and seed, so it is reproducible and needs no global
    sort. With ``normal_only=False`` every session takes part, and sessions of insiders are
    in the test split as well, as rows of their own.
    """
    keyed = labelled.selectExpr("*", f"{hash_key('session_id', seed)} AS _hash")
    pool = keyed.where("label_user = 0") if normal_only else keyed
    placed = ordinal(
        pool.selectExpr("*", f"{hash_slice('_hash')} AS _slice"),
        [],
        ["_hash", "session_id"],
        "_slice",
        total="_total",
    )
    n_train, n_val = f"floor(_total * {train}D)", f"floor(_total * {val}D)"
    split = f"CASE WHEN _n <= {n_train} THEN 'train' WHEN _n <= {n_train} + {n_val} THEN 'val' ELSE 'test' END"
    normal = placed.selectExpr(*labelled.columns, f"{split} AS split", "'normal' AS split_group")
    insiders = keyed.where("label_user = 1").selectExpr(
        *labelled.columns, "'test' AS split", "'insider' AS split_group"
    )
    return normal.unionByName(insiders)


def cutoffs(labelled: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """One row: min_time, train_cutoff, val_cutoff from whole days of the time range."""
    span = labelled.agg(F.expr("min(start_time) AS min_time"), F.expr("max(start_time) AS max_time"))
    days = "timestampdiff(MICROSECOND, min_time, max_time) div 86400000000"
    return span.selectExpr("min_time", f"{days} AS days").selectExpr(
        "min_time",
        f"min_time + make_dt_interval(CAST(floor(days * {train}D) AS INT)) AS train_cutoff",
        f"min_time + make_dt_interval(CAST(floor(days * ({train}D + {val}D)) AS INT)) AS val_cutoff",
    )


def split_temporal(labelled: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """Adds ``split`` by start time; labelled sessions before the test period get NULL."""
    cut = cutoffs(labelled, train, val).selectExpr("struct(train_cutoff, val_cutoff)").scalar()
    split = """CASE WHEN start_time >= _cut.val_cutoff THEN 'test' WHEN label = 1 THEN NULL
        WHEN start_time < _cut.train_cutoff THEN 'train' ELSE 'val' END AS split"""
    return labelled.withColumn("_cut", cut).selectExpr(*labelled.columns, split)


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.expr("count(*) AS sessions"),
        F.expr("sum(label_session) AS session_positives"),
        F.expr("sum(label_user) AS user_positives"),
        F.expr("min(start_time) AS first_start"),
        F.expr("max(start_time) AS last_start"),
    )


def sample_sessions(df: DataFrame, n: int, seed: int = 42, *, id_col: str = "session_id") -> DataFrame:
    """Reproducible random sample of exactly ``n`` rows (all rows if there are fewer).

    A histogram over hash slices finds the slice in which the n-th row lies, so that only
    about n rows reach the final ordering.
    """
    keyed = df.selectExpr("*", f"{hash_key(id_col, seed)} AS _hash")
    sliced = keyed.selectExpr("*", f"{hash_slice('_hash')} AS _slice")
    upto = "sum(_rows) OVER (PARTITION BY 0 ORDER BY _slice) AS _upto"
    last = (
        sliced.groupBy("_slice")
        .agg(F.expr("count(*) AS _rows"))
        .selectExpr("_slice", "_rows", upto)
        .where(f"_upto - _rows < {n}")
        .agg(F.max("_slice"))
        .scalar()
    )
    return sliced.where(F.col("_slice") <= last).orderBy("_hash", id_col).limit(n).select(*df.columns)


@dataclass
class Prepared:
    """Sequences with split and labels, the fitted model, and split metadata."""

    sequences: DataFrame
    model: FeatureModel
    metadata: DataFrame


def _prepare(labelled, split, fit_rows, keys, length, role_mode, role_map) -> Prepared:
    categories = role_categories(labelled) if role_mode == "roles" and "role" in labelled.columns else None
    model = fit_features(fit_rows, role_mode=role_mode, categories=categories, role_map=role_map)
    vectors = feature_vector(split, model)
    keep = ["split", "label_user", "label_session"]
    built = sequences(
        vectors, length, model.padding, keys=keys, keep=[c for c in keep if c not in keys]
    )
    return Prepared(built, model, split_summary(split))


def prepare_random(
    features: DataFrame,
    users: DataFrame,
    incidents: DataFrame | None,
    length: int = 100,
    *,
    train: float = 0.7,
    val: float = 0.1,
    seed: int = 42,
    normal_only: bool = True,
    role_mode: str = "none",
    role_map: object | None = None,
) -> Prepared:
    """Labels, random split, fit on all normal sessions, histories per normal/insider group."""
    labelled = materialise(label_sessions(features, users, incidents), "labelled")
    split = split_random(labelled, train, val, seed, normal_only=normal_only)
    fit_rows = labelled.where("label_user = 0") if normal_only else labelled
    return _prepare(labelled, split, fit_rows, ["split_group", "user_id"], length, role_mode, role_map)


def prepare_temporal(
    features: DataFrame,
    users: DataFrame,
    incidents: DataFrame | None,
    length: int = 100,
    *,
    train: float = 0.7,
    val: float = 0.1,
    role_mode: str = "none",
    role_map: object | None = None,
) -> Prepared:
    """Labels, time split, fit on the training period only, histories inside each split."""
    labelled = materialise(label_sessions(features, users, incidents), "labelled")
    split = split_temporal(labelled, train, val).where("split IS NOT NULL")
    return _prepare(
        labelled, split, split.where("split = 'train'"), ["split", "user_id"], length, role_mode, role_map
    )

