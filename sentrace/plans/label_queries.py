"""Labels, splits, samples and prepared data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sentrace.operators import labels as L
from sentrace.plans import adapters as A
from sentrace.plans.base import stored, with_views
from sentrace.plans.feature_queries import prepared_sql

SEED = 42
SAMPLE = 500
LENGTH = 100


def labelled(s, d):
    incidents = A.incidents(s, d)
    return L.label_sessions(stored(s, d, "enriched"), incidents, incidents)


def _step_totals(length, width):
    """Column function of ``seq``: for each feature the sum of its values, each times its step (from 1)."""

    @F.arrow_udf("array<double>")
    def totals(seq: pa.Array) -> pa.Array:
        cells = seq.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(seq), length, width)
        out = np.zeros((len(seq), width))
        for step in range(length):
            out += (step + 1) * cells[:, step]
        ends = pa.array(np.arange(len(seq) + 1) * width, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    return totals


def _prepared(kind):
    """Every feature of every prepared session: the sum of its values over the steps, each times its step (from 1)."""

    def run(s, d):
        incidents = A.incidents(s, d)
        prepare = L.prepare_random if kind == "random" else L.prepare_temporal
        found = prepare(stored(s, d, "enriched"), incidents, incidents, LENGTH)
        names = found.model.names
        totals = ", ".join(f"struct('{f}' AS feature, round(_totals[{i}], 5) AS total)" for i, f in enumerate(names))
        summed = found.sequences.withColumn("_totals", _step_totals(LENGTH, len(names))(F.col("seq")))
        return summed.selectExpr(
            "session_id",
            "user_id",
            "split",
            "label_user",
            "label_session",
            "size(seq) AS steps",
            "aggregate(mask, 0, (t, x) -> t + x) AS real_steps",
            f"inline(array({totals}))",
        )

    return run


IDS = ["session_id", "user_id", "start_time", "label_user", "label_session"]

QUERIES = {
    "incidents": lambda s, d: A.incidents(s, d),
    "label_sessions": lambda s, d: labelled(s, d).select(*IDS, "label"),
    "label_counts": lambda s, d: L.label_counts(labelled(s, d)).selectExpr(
        "sessions",
        "user_positives",
        "session_positives",
        "round(user_pct, 9) AS user_pct",
        "round(session_pct, 9) AS session_pct",
    ),
    "split_random": lambda s, d: L.split_random(labelled(s, d).select(*IDS), seed=SEED).select("session_id", "split"),
    "split_temporal": lambda s, d: L.split_temporal(labelled(s, d)).select("session_id", "split"),
    "split_summary": lambda s, d: L.split_summary(L.split_temporal(labelled(s, d)).where("split IS NOT NULL")),
    "sample_sessions": lambda s, d: L.sample_sessions(
        stored(s, d, "features").select("session_id", "user_id"), SAMPLE, SEED
    ),
    "prepare_random": _prepared("random"),
    "prepare_temporal": _prepared("temporal"),
    "cutoffs": lambda s, d: L.cutoffs(stored(s, d, "features").where(F.col("start_time").isNotNull())),
}

_CUT = """SELECT min_time, min_time + to_days(CAST(floor(days * CAST(0.7 AS DOUBLE)) AS INTEGER)) AS train_cutoff,
    min_time + to_days(CAST(floor(days * (CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE))) AS INTEGER)) AS val_cutoff
    FROM (SELECT min(start_time) AS min_time,
        date_diff('microsecond', min(start_time), max(start_time)) // 86400000000 AS days FROM {source})"""
_TEMPORAL = f"""SELECT l.*, CASE WHEN start_time >= val_cutoff THEN 'test' WHEN label = 1 THEN NULL
    WHEN start_time < train_cutoff THEN 'train' ELSE 'val' END AS split
    FROM labelled l, ({_CUT.format(source='labelled')})"""
_RANDOM = f"""SELECT *, CASE WHEN n <= floor(total * CAST(0.7 AS DOUBLE)) THEN 'train'
        WHEN n <= floor(total * CAST(0.7 AS DOUBLE)) + floor(total * CAST(0.1 AS DOUBLE)) THEN 'val'
        ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(session_id AS VARCHAR), ':{SEED}')), session_id) AS n,
            count(*) OVER () AS total FROM labelled WHERE label_user = 0)
    UNION ALL BY NAME SELECT *, 'test' AS split FROM labelled WHERE label_user = 1"""


ORACLE = {
    "incidents": with_views("incidents", body="SELECT * FROM incidents"),
    "label_sessions": with_views(
        "labelled", body="SELECT session_id, user_id, start_time, label_user, label_session, label FROM labelled"
    ),
    "label_counts": with_views(
        "labelled",
        body="""SELECT count(*) AS sessions, CAST(sum(label_user) AS BIGINT) AS user_positives,
            CAST(sum(label_session) AS BIGINT) AS session_positives,
            round(CAST(100 * sum(label_user) AS DOUBLE) / count(*), 9) AS user_pct,
            round(CAST(100 * sum(label_session) AS DOUBLE) / count(*), 9) AS session_pct FROM labelled""",
    ),
    "split_random": with_views("labelled", body=f"SELECT session_id, split FROM ({_RANDOM})"),
    "split_temporal": with_views("labelled", body=f"SELECT session_id, split FROM ({_TEMPORAL})"),
    "split_summary": with_views(
        "labelled",
        body=f"""SELECT split, count(*) AS sessions, CAST(sum(label_session) AS BIGINT) AS session_positives,
            CAST(sum(label_user) AS BIGINT) AS user_positives, min(start_time) AS first_start,
            max(start_time) AS last_start FROM ({_TEMPORAL}) WHERE split IS NOT NULL GROUP BY split""",
    ),
    "sample_sessions": with_views(
        "sessions",
        body=f"""SELECT session_id, user_id FROM sessions
            ORDER BY md5(concat(CAST(session_id AS VARCHAR), ':{SEED}')), session_id LIMIT {SAMPLE}""",
    ),
    "prepare_random": prepared_sql(_RANDOM, "label_user, user_id", "SELECT * FROM labelled WHERE label_user = 0"),
    "prepare_temporal": prepared_sql(_TEMPORAL, "split, user_id", "SELECT * FROM placed WHERE split = 'train'"),
    "cutoffs": with_views("sessions", body=_CUT.format(source="sessions")),
}
