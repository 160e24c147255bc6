"""Score percentiles, curves, classification metrics, time to detect."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentrace.operators import metrics as M
from sentrace.plans import adapters as A
from sentrace.plans.base import union_all, with_views
from sentrace.plans.label_queries import labelled
from sentrace.storage import materialise

KS = (100, 500, 1000)
TARGETS = (0.01, 0.05, 0.10)
PERCENTILE = 80


def _values(s, d):
    return A.table(s, d, "events").select("event_id", F.col("value").alias("score"))


def _scores(s, d):
    """Labelled sessions with their length as the score."""
    return labelled(s, d).selectExpr(
        "session_id", "user_id", "start_time", "duration_minutes AS score", "label_user", "label_session"
    )


def _rounded(df, *columns):
    return df.selectExpr(*[f"round({c}, 9) AS {c}" if c in columns else c for c in df.columns])


def _ttd(kind):
    def run(s, d):
        scored = materialise(_scores(s, d), "scores")
        incidents = A.incidents(s, d)
        threshold = M.score_thresholds(scored, [PERCENTILE])
        if kind == "total":
            out = M.time_to_detect(scored, incidents, threshold)
        elif kind == "substring":
            named = scored.selectExpr("concat(user_id, '-', session_id) AS session_id", "start_time", "score")
            out = M.time_to_detect(named, incidents, threshold, by_substring=True)
        else:
            out = M.ttd_per_incident(scored, incidents, threshold)
            if kind == "user":
                out = M.last_incident_per_user(out)
        return _rounded(out, *[c for c, t in out.dtypes if t == "double"])

    return run


def _details(s, d):
    scored = materialise(_scores(s, d), "scores")
    return _rounded(M.session_details(scored, M.score_thresholds(scored, [95])), "percentile")


def _levels(s, d):
    """Metrics of two simple scores at session and user level, one wide row each."""
    base = materialise(
        labelled(s, d).select("session_id", "duration_minutes", "total_actions", "label_user", "label_session"),
        "levels",
    )
    rows = []
    for model in ("duration_minutes", "total_actions"):
        for level in ("session", "user"):
            scored = base.selectExpr("session_id", f"CAST({model} AS DOUBLE) AS score", f"label_{level} AS label")
            threshold = M.score_thresholds(scored, [95])
            one = M.classification_metrics(scored, threshold).selectExpr(
                f"'{model}' AS model", f"'{level}' AS level", "f1 AS f1_score", "precision", "recall"
            )
            rows.append(one.withColumn("auc_roc", M.roc_auc(scored).scalar()))
    return union_all(rows)


QUERIES = {
    "anomaly_percentile": lambda s, d: _rounded(M.anomaly_percentile(_values(s, d)), "pct"),
    "percentile_vs_reference": lambda s, d: _rounded(
        M.percentile_vs_reference(
            _values(s, d),
            A.table(s, d, "events").where("event_type = 'purchase'").select(F.col("value").alias("score")),
        ),
        "pct",
    ),
    "score_thresholds": lambda s, d: _rounded(M.score_thresholds(_values(s, d)), "threshold"),
    "score_summary": lambda s, d: _rounded(M.score_summary(_values(s, d)), "mean_score", "std_score"),
    "roc_curve": lambda s, d: _rounded(M.roc_curve(A.scored_documents(s, d)), "tpr", "fpr"),
    "roc_corners": lambda s, d: _rounded(M.roc_corners(A.scored_documents(s, d)), "tpr", "fpr").where(
        "NOT threshold = CAST('Infinity' AS DOUBLE)"
    ),
    "pr_curve": lambda s, d: _rounded(M.pr_curve(A.scored_documents(s, d)), "recall", "precision"),
    "roc_auc": lambda s, d: _rounded(M.roc_auc(A.scored_documents(s, d)), "roc_auc"),
    "average_precision": lambda s, d: _rounded(M.average_precision(A.scored_documents(s, d)), "average_precision"),
    "best_f1_threshold": lambda s, d: _rounded(M.best_f1_threshold(A.scored_documents(s, d)), "f1"),
    "classification_metrics": lambda s, d: _rounded(
        M.classification_metrics(A.scored_documents(s, d), M.score_thresholds(A.scored_documents(s, d), [95])),
        "threshold",
        "accuracy",
        "precision",
        "recall",
        "f1",
        "fpr",
    ),
    "precision_at_k": lambda s, d: _rounded(M.precision_at_k(A.scored_documents(s, d), KS), "precision"),
    "recall_at_fpr": lambda s, d: _rounded(
        M.recall_at_fpr(A.scored_documents(s, d), TARGETS), "recall", "actual_fpr"
    ),
    "model_metrics": lambda s, d: _rounded(
        M.model_metrics(A.scored_documents(s, d), "n_chars"),
        "val_error",
        "roc_auc",
        "average_precision",
        "precision_at_100",
        "recall_at_fpr_5",
        "f1_at_optimal",
    ),
    "session_details": _details,
    "time_to_detect": _ttd("total"),
    "time_to_detect_substr": _ttd("substring"),
    "ttd_per_incident": _ttd("incident"),
    "ttd_last_per_user": _ttd("user"),
    "compare_models": lambda s, d: _rounded(M.compare_models(_levels(s, d)), "value"),
}

_POINTS = """SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p,
        sum(neg) OVER () AS n, pos
    FROM (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
        FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""
_TPR = "CASE WHEN p = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / p END"
_FPR = "CASE WHEN n = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / n END"
_CORNERS = f"""SELECT threshold, {_TPR} AS tpr, {_FPR} AS fpr FROM (SELECT *, lag(tp) OVER v AS ptp,
        lag(fp) OVER v AS pfp, lead(tp) OVER v AS ntp, lead(fp) OVER v AS nfp
        FROM ({_POINTS}) WINDOW v AS (ORDER BY threshold DESC))
    WHERE ptp IS NULL OR ntp IS NULL OR ntp - tp <> tp - ptp OR nfp - fp <> fp - pfp"""
_CORNERS_0 = f"{_CORNERS} UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0"
_AUC = """SELECT CASE WHEN p * n = 0 THEN 0.5 ELSE (rank_sum - p * (p + 1) / 2.0) / (p * n) END AS roc_auc
    FROM (SELECT CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n,
        sum(CASE WHEN label = 1 THEN mid END) AS rank_sum
        FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid
            FROM {source}))"""
_F1 = f"""SELECT threshold, 2 * (prec * rec) / (prec + rec + 1e-8) AS f1
    FROM (SELECT threshold, {_TPR} AS rec, CAST(tp AS DOUBLE) / (tp + fp) AS prec FROM ({_POINTS}))
    ORDER BY f1 DESC, threshold LIMIT 1"""


def _confusion(source: str, threshold: str) -> str:
    return f"""SELECT threshold, tp, tn, fp, fn, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
        CASE WHEN fp + tn = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / (fp + tn) END AS fpr
        FROM (SELECT max(t) AS threshold, count(*) FILTER (WHERE score > t AND label = 1) AS tp,
            count(*) FILTER (WHERE score <= t AND label <> 1) AS tn,
            count(*) FILTER (WHERE score > t AND label <> 1) AS fp,
            count(*) FILTER (WHERE score <= t AND label = 1) AS fn
            FROM {source}, (SELECT {threshold} AS t FROM {source}))"""


_SCORED_SESSIONS = """SELECT session_id, user_id, start_time, duration_minutes AS score, label_user, label_session
    FROM labelled"""
_INCIDENT_ROWS = f"""
    SELECT user_id, inc_start, inc_end, duration_hours, total_sessions, first_time IS NOT NULL AS detected, ttd_hours,
        first_time AS detected_at, CASE WHEN first_time IS NOT NULL THEN sessions_to_detect END AS sessions_to_detect,
        ttd_hours / duration_hours * 100 AS lag_pct
    FROM (SELECT user_id, inc_start, inc_end, count(*) AS total_sessions,
            min(CASE WHEN hit THEN start_time END) AS first_time, min(CASE WHEN hit THEN idx END) AS sessions_to_detect,
            greatest(0.0, date_diff('microsecond', inc_start, min(CASE WHEN hit THEN start_time END))
                / CAST(3.6e9 AS DOUBLE)) AS raw_hours,
            CASE WHEN min(CASE WHEN hit THEN start_time END) IS NOT NULL THEN greatest(0.0, date_diff('microsecond',
                inc_start, min(CASE WHEN hit THEN start_time END)) / CAST(3.6e9 AS DOUBLE)) END AS ttd_hours,
            date_diff('microsecond', inc_start, inc_end) / CAST(3.6e9 AS DOUBLE) AS duration_hours
        FROM (SELECT i.user_id, i.inc_start, i.inc_end, s.start_time, s.score > t.t AS hit,
                row_number() OVER (PARTITION BY i.user_id, i.inc_start, i.inc_end
                    ORDER BY s.start_time, s.session_id) - 1 AS idx
            FROM incidents i JOIN scored_sessions s ON s.user_id = i.user_id
                AND s.start_time BETWEEN i.inc_start AND i.inc_end,
                (SELECT quantile_cont(score, {PERCENTILE / 100}) AS t FROM scored_sessions) t)
        GROUP BY user_id, inc_start, inc_end)"""


def _with_scores(body: str) -> str:
    text = with_views("labelled", "incidents", body="SELECT 1")
    ctes = text[: text.rindex("SELECT 1")].rstrip()
    return f"{ctes},\nscored_sessions AS ({_SCORED_SESSIONS}),\nper_incident AS ({_INCIDENT_ROWS})\n{body}"


_INCIDENT_COLUMNS = """user_id, inc_start, inc_end, round(duration_hours, 9) AS duration_hours, total_sessions,
    detected, round(ttd_hours, 9) AS ttd_hours, detected_at, sessions_to_detect, round(lag_pct, 9) AS lag_pct"""
_TOTALS = """SELECT count(*) FILTER (WHERE detected) AS n_detected,
    round(coalesce(avg(ttd_hours), 0.0), 9) AS ttd_hours_mean,
    round(coalesce(avg(sessions_to_detect), 0.0), 9) AS ttd_sessions_mean,
    round(coalesce(avg(least(100.0, greatest(0.0, lag_pct))) FILTER (WHERE detected), 0.0), 9) AS ttd_lag_mean,
    round(coalesce(100.0 * CAST(count(*) FILTER (WHERE sessions_to_detect = 0) AS DOUBLE)
        / nullif(count(*) FILTER (WHERE detected), 0), 0.0), 9) AS pct_first_session,
    round(coalesce(median(ttd_hours), 0.0), 9) AS ttd_hours_median,
    round(coalesce(median(least(100.0, greatest(0.0, lag_pct))) FILTER (WHERE detected), 0.0), 9) AS ttd_lag_median,
    (SELECT count(*) FROM incidents) AS n_total FROM per_incident"""


def _compare_sql() -> str:
    parts = []
    for model in ("duration_minutes", "total_actions"):
        for level in ("session", "user"):
            source = f"(SELECT CAST({model} AS DOUBLE) AS score, label_{level} AS label FROM labelled)"
            parts.append(
                f"""SELECT '{model}' AS model, '{level}' AS level, unnest(['auc_roc', 'f1_score', 'precision',
                    'recall']) AS metric, unnest([round(a.roc_auc, 9), round(c.f1, 9), round(c.precision, 9),
                    round(c.recall, 9)]) AS value
                FROM ({_AUC.format(source=source)}) a, ({_confusion(source, 'quantile_cont(score, 0.95)')}) c"""
            )
    return with_views("labelled", body=" UNION ALL ".join(parts))


ORACLE = {
    "anomaly_percentile": """SELECT event_id, value AS score, round(100.0 * (rank() OVER (ORDER BY value) - 1)
        / CAST(count(*) OVER () AS DOUBLE), 9) AS pct FROM events""",
    "percentile_vs_reference": """SELECT e.event_id, e.value AS score,
        round(CAST(100 * (SELECT count(*) FROM events r WHERE r.event_type = 'purchase' AND r.value < e.value)
            AS DOUBLE) / (SELECT count(*) FROM events WHERE event_type = 'purchase'), 9) AS pct FROM events e""",
    "score_thresholds": """SELECT CAST(p AS DOUBLE) AS p, round(t, 9) AS threshold FROM (
        SELECT unnest([90, 95, 99]) AS p, unnest(quantile_cont(value, [0.9, 0.95, 0.99])) AS t FROM events)""",
    "score_summary": """SELECT count(*) AS n, min(value) AS min_score, max(value) AS max_score,
        round(avg(value), 9) AS mean_score, round(stddev_pop(value), 9) AS std_score FROM events""",
    "roc_curve": with_views(
        "scored",
        body=f"""SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round({_TPR}, 9) AS tpr,
            round({_FPR}, 9) AS fpr FROM ({_POINTS})""",
    ),
    "roc_corners": with_views(
        "scored", body=f"SELECT threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM ({_CORNERS})"
    ),
    "pr_curve": with_views(
        "scored",
        body=f"""SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round({_TPR}, 9) AS recall,
            round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision FROM ({_POINTS})""",
    ),
    "roc_auc": with_views(
        "scored", body=f"SELECT round(roc_auc, 9) AS roc_auc FROM ({_AUC.format(source='scored')})"
    ),
    "average_precision": with_views(
        "scored",
        body=f"""SELECT round(sum(CAST(pos AS DOUBLE) / p * (CAST(tp AS DOUBLE) / (tp + fp))), 9)
            AS average_precision FROM ({_POINTS})""",
    ),
    "best_f1_threshold": with_views("scored", body=f"SELECT threshold, round(f1, 9) AS f1 FROM ({_F1})"),
    "classification_metrics": with_views(
        "scored",
        body=f"""SELECT round(threshold, 9) AS threshold, tp, tn, fp, fn, round(accuracy, 9) AS accuracy,
            round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(fpr, 9) AS fpr
            FROM ({_confusion('scored', 'quantile_cont(score, 0.95)')})""",
    ),
    "precision_at_k": with_views(
        "scored",
        body="""SELECT CAST(k AS INTEGER) AS k, round(CAST(sum(CASE WHEN n <= k THEN label ELSE 0 END) AS DOUBLE) / k,
            9) AS precision FROM (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS n FROM scored),
            (SELECT unnest([100, 500, 1000]) AS k) GROUP BY k""",
    ),
    "recall_at_fpr": with_views(
        "scored",
        body=f"""SELECT CAST(target AS DOUBLE) AS target, round(tpr, 9) AS recall, round(fpr, 9) AS actual_fpr,
            threshold FROM (SELECT *, row_number() OVER (PARTITION BY target
                ORDER BY abs(fpr - CAST(target AS DOUBLE)), threshold DESC) AS n
                FROM ({_CORNERS_0}), (SELECT unnest([0.01, 0.05, 0.1]) AS target)) WHERE n = 1""",
    ),
    "model_metrics": with_views(
        "scored",
        body=f"""SELECT 'n_chars' AS model, round(v.e, 9) AS val_error, round(a.roc_auc, 9) AS roc_auc,
            round(q.ap, 9) AS average_precision, round(k.pk, 9) AS precision_at_100,
            round(r.tpr, 9) AS recall_at_fpr_5, f.threshold AS optimal_threshold, round(f.f1, 9) AS f1_at_optimal
            FROM (SELECT avg(score) FILTER (WHERE label = 0) AS e FROM scored) v,
                ({_AUC.format(source='scored')}) a,
                (SELECT sum(CAST(pos AS DOUBLE) / p * (CAST(tp AS DOUBLE) / (tp + fp))) AS ap FROM ({_POINTS})) q,
                (SELECT CAST(sum(label) AS DOUBLE) / 100 AS pk FROM
                    (SELECT label FROM scored ORDER BY score DESC, id LIMIT 100)) k,
                (SELECT tpr FROM ({_CORNERS_0}) ORDER BY abs(fpr - CAST(0.05 AS DOUBLE)), threshold DESC LIMIT 1) r,
                ({_F1}) f""",
    ),
    "session_details": _with_scores(
        """SELECT session_id, user_id, start_time AS timestamp, score AS anomaly_score,
            round(100.0 * cume_dist() OVER (ORDER BY score), 9) AS percentile, label_user = 1 AS is_insider_user,
            label_session = 1 AS is_insider_session,
            score > (SELECT quantile_cont(score, 0.95) FROM scored_sessions) AS detected FROM scored_sessions"""
    ),
    "time_to_detect": _with_scores(_TOTALS),
    "time_to_detect_substr": _with_scores(_TOTALS),
    "ttd_per_incident": _with_scores(f"SELECT {_INCIDENT_COLUMNS} FROM per_incident"),
    "ttd_last_per_user": _with_scores(
        f"""SELECT {_INCIDENT_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY inc_start DESC, inc_end DESC) AS n FROM per_incident) WHERE n = 1"""
    ),
    "compare_models": _compare_sql(),
}
