"""Thresholds, curves and detection metrics over scored, labelled rows.

Curves are computed on one row per distinct score. The running counts along the score
are cut into slices, so no step sorts all scores in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.functions.columns import clamp_hours, hours_between, ratio, text_literal, time_bucket
from sentrace.operators.intervals import DAY, interval_slices
from sentrace.operators.ordered import next_in_order, previous_in_order, running_sums, with_value_slices
from sentrace.operators.quantiles import exact_quantiles, unpivot, value_ranks
from sentrace.operators.substrings import words_inside
from sentrace.storage import materialise


def _one_row(*parts: DataFrame) -> DataFrame:
    """Side by side join of one-row frames."""
    out = parts[0]
    for part in parts[1:]:
        for name in part.columns:
            out = out.withColumn(name, part.select(name).scalar())
    return out


# ---- percentiles and thresholds ----


def anomaly_percentile(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``pct``: share of all scores strictly below, times 100; NULL for NULL and NaN, which count nowhere."""
    ranks = value_ranks(scores.select(score), score).selectExpr(f"{score} AS _score", "100D * below / total AS pct")
    return scores.join(ranks, F.expr(f"{score} = _score"), "left").drop("_score")


def percentile_vs_reference(scores: DataFrame, reference: DataFrame | None, score: str = "score") -> DataFrame:
    """Adds ``pct``: share of the reference scores strictly below; 50 without a reference.

    Both score columns run through one running count, so the reference may be of any size.
    """
    if reference is None:
        return scores.selectExpr("*", "50D AS pct")
    real = f"{score} IS NOT NULL AND NOT isnan(CAST({score} AS DOUBLE))"
    known = reference.where(real).groupBy(score).agg(F.expr("count(*) AS _count"))
    asked = scores.where(real).select(score).distinct().selectExpr(score, "0L AS _count")
    points = (
        known.unionByName(asked)
        .groupBy(score)
        .agg(F.expr("sum(_count) AS _count"))
    )
    ranks = running_sums(
        with_value_slices(points, score, count="_count"), [], [score], "_slice", {"_upto": "_count"}, totals={"_total": "_upto"}
    ).selectExpr(
        f"{score} AS _score",
        "CASE WHEN _total = 0 THEN 50D ELSE 100D * (_upto - _count) / _total END AS pct",
    )
    return scores.join(ranks, F.expr(f"{score} = _score"), "left").drop("_score")


def score_thresholds(
    scores: DataFrame, ps: Sequence[float] = (90, 95, 99), *, score: str = "score", approx: bool = False
) -> DataFrame:
    """(p, threshold); exact with interpolation, or from a sketch with ``approx``."""
    if approx:
        fractions = ", ".join(str(p / 100) for p in ps)
        points = ", ".join(f"{float(p)!r}D" for p in ps)
        found = scores.agg(F.expr(f"percentile_approx({score}, array({fractions}), 10000) AS _q"))
        return found.selectExpr(f"inline(zip_with(array({points}), _q, (p, t) -> struct(p AS p, t AS threshold)))")
    exact = exact_quantiles(unpivot(scores, [score]), [p / 100 for p in ps])
    cases = " ".join(f"WHEN {p / 100!r}D THEN {float(p)!r}D" for p in ps)
    return exact.selectExpr(f"CASE p {cases} END AS p", "quantile AS threshold")


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.agg(
        F.expr("count(*) AS n"),
        F.expr(f"min({score}) AS min_score"),
        F.expr(f"max({score}) AS max_score"),
        F.expr(f"avg({score}) AS mean_score"),
        F.expr(f"stddev_pop({score}) AS std_score"),
    )


# ---- curves ----


def _operating_points(scores: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, positives, negatives) for "score >= threshold", per distinct score."""
    counted = scores.groupBy(F.col(score).alias("threshold")).agg(
        F.expr(f"count_if({label} = 1) AS _pos"), F.expr(f"count_if({label} <> 1) AS _neg")
    )
    return running_sums(
        with_value_slices(counted, "threshold", count="(_pos + _neg)"),
        [],
        ["threshold DESC"],
        "_slice",
        {"tp": "_pos", "fp": "_neg"},
        totals={"positives": "tp", "negatives": "fp"},
        slice_descending=True,
    )


def roc_curve(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Operating points (threshold, tp, fp, tpr, fpr), one per distinct score."""
    return _operating_points(scores, score, label).selectExpr(
        "threshold",
        "tp",
        "fp",
        f"{ratio('tp', 'positives')} AS tpr",
        f"{ratio('fp', 'negatives')} AS fpr",
    )


def roc_corners(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC points without inner ones on a straight line between their neighbours.

    Adds the point (0, 0) at an infinite threshold.
    """
    return _corners(materialise(_operating_points(scores, score, label), "points"))


def _corners(points: DataFrame) -> DataFrame:
    # Slices of equal size along the score serve both neighbour look-ups.
    keyed = points.selectExpr("*", "-_slice AS _down", "-threshold AS _order")
    before = previous_in_order(keyed, [], ["_order"], "_down", {"_ptp": "tp", "_pfp": "fp"})
    around = next_in_order(before, [], ["_order"], "_down", {"_ntp": "tp", "_nfp": "fp"})
    bend = """_ntp IS NULL OR _ptp IS NULL
        OR (_ntp - tp) <> (tp - _ptp) OR (_nfp - fp) <> (fp - _pfp)"""
    corners = around.where(bend).selectExpr(
        "threshold", f"{ratio('tp', 'positives')} AS tpr", f"{ratio('fp', 'negatives')} AS fpr"
    )
    origin = points.limit(1).selectExpr("CAST('Infinity' AS DOUBLE) AS threshold", "0D AS tpr", "0D AS fpr")
    return corners.unionByName(origin)


def pr_curve(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Operating points (threshold, tp, fp, recall, precision), one per distinct score."""
    return _operating_points(scores, score, label).selectExpr("threshold", "tp", "fp", *_PR)


_PR = (f"{ratio('tp', 'positives')} AS recall", f"{ratio('tp', '(tp + fp)')} AS precision")


def roc_auc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve from mid-ranks; 0.5 with a single class."""
    return _auc(_operating_points(scores, score, label))


def _auc(points: DataFrame) -> DataFrame:
    # A positive beats every negative with a lower score and half of those with the same one.
    wins = points.agg(
        F.expr("sum(CAST(_pos AS DOUBLE) * (negatives - fp + _neg / 2D)) AS _wins"),
        F.expr("CAST(max(positives) AS DOUBLE) * max(negatives) AS _pairs"),
    )
    return wins.selectExpr("CASE WHEN coalesce(_pairs, 0D) = 0 THEN 0.5D ELSE _wins / _pairs END AS roc_auc")


def average_precision(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum over operating points of (recall gained) x precision; 0 without positives."""
    return _average_precision(_operating_points(scores, score, label))


def _average_precision(points: DataFrame) -> DataFrame:
    gained = "_pos * (CAST(tp AS DOUBLE) / (tp + fp))"
    return points.agg(F.expr(f"sum({gained}) AS _sum"), F.expr("max(positives) AS _p")).selectExpr(
        "CASE WHEN coalesce(_p, 0) = 0 THEN 0D ELSE _sum / _p END AS average_precision"
    )


def best_f1_threshold(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold of the best F1 for "score >= threshold"; the lowest one on ties."""
    return _best_f1(_operating_points(scores, score, label))


def _best_f1(points: DataFrame) -> DataFrame:
    f1 = "2 * (precision * recall) / (precision + recall + 1e-8D)"
    return (
        points.selectExpr("threshold", *_PR)
        .selectExpr("threshold", f"{f1} AS f1")
        .agg(F.expr("max_by(struct(threshold, f1), struct(f1, -threshold)) AS _best"))
        .select("_best.*")
    )


def classification_metrics(
    scores: DataFrame,
    threshold: float | DataFrame,
    *,
    strict: bool = True,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Confusion counts and rates at a threshold (a number or a one-row frame ``threshold``)."""
    cut = threshold.select("threshold").scalar() if isinstance(threshold, DataFrame) else F.lit(float(threshold))
    hit = f"{score} > _cut" if strict else f"{score} >= _cut"
    marked = scores.withColumn("_cut", cut).selectExpr(f"{hit} AS _hit", f"{label} = 1 AS _pos", "_cut")
    counts = marked.agg(
        F.expr("max(_cut) AS threshold"),
        F.expr("count_if(_hit AND _pos) AS tp"),
        F.expr("count_if(NOT _hit AND NOT _pos) AS tn"),
        F.expr("count_if(_hit AND NOT _pos) AS fp"),
        F.expr("count_if(NOT _hit AND _pos) AS fn"),
    )
    return counts.selectExpr(
        "threshold",
        "tp",
        "tn",
        "fp",
        "fn",
        f"{ratio('(tp + tn)', '(tp + tn + fp + fn)')} AS accuracy",
        f"{ratio('tp', '(tp + fp)')} AS precision",
        f"{ratio('tp', '(tp + fn)')} AS recall",
        f"{ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1",
        f"{ratio('fp', '(fp + tn)')} AS fpr",
    )


def precision_at_k(
    scores: DataFrame,
    ks: Sequence[int] = (100, 500, 1000),
    *,
    score: str = "score",
    label: str = "label",
    id_col: str = "id",
) -> DataFrame:
    """(k, precision) over the k highest scores, ties by id; always divided by k."""
    top = scores.select(id_col, score, label).orderBy(F.desc(score), id_col).limit(max(ks))
    placed = top.selectExpr(label, f"row_number() OVER (PARTITION BY 0 ORDER BY {score} DESC, {id_col}) AS _n")
    wanted = ", ".join(str(k) for k in ks)
    return (
        placed.selectExpr(label, "_n", f"explode(array({wanted})) AS k")
        .groupBy("k")
        .agg(F.expr(f"sum(CASE WHEN _n <= k AND {label} = 1 THEN 1 ELSE 0 END) / CAST(k AS DOUBLE) AS precision"))
    )


def recall_at_fpr(
    scores: DataFrame, targets: Sequence[float] = (0.01, 0.05, 0.10), score: str = "score", label: str = "label"
) -> DataFrame:
    """(target, recall, actual_fpr, threshold) at the ROC corner nearest to each target FPR.

    On equal distance the corner with the higher threshold wins.
    """
    return _recall_at(roc_corners(scores, score, label), targets)


def _recall_at(corners: DataFrame, targets: Sequence[float]) -> DataFrame:
    wanted = ", ".join(f"{t!r}D" for t in targets)
    return (
        corners.selectExpr("*", f"explode(array({wanted})) AS target")
        .groupBy("target")
        .agg(F.expr("min_by(struct(tpr, fpr, threshold), struct(abs(fpr - target), -threshold)) AS _at"))
        .selectExpr("target", "_at.tpr AS recall", "_at.fpr AS actual_fpr", "_at.threshold AS threshold")
    )


def model_metrics(
    scores: DataFrame, name: str, *, score: str = "score", label: str = "label", id_col: str = "id"
) -> DataFrame:
    """One evaluation row of a model.

    The operating points (one row per distinct score) are stored once; all curve metrics
    come from them.
    """
    points = materialise(_operating_points(scores, score, label), "points")
    error = scores.agg(
        F.expr(f"coalesce(avg({score}) FILTER (WHERE {label} = 0), avg({score})) AS val_error")
    ).selectExpr(f"{text_literal(name)} AS model", "val_error")
    top = precision_at_k(scores, [100], score=score, label=label, id_col=id_col)
    best = _best_f1(points)
    return _one_row(
        error,
        _auc(points),
        _average_precision(points),
        top.selectExpr("precision AS precision_at_100"),
        _recall_at(_corners(points), [0.05]).selectExpr("recall AS recall_at_fpr_5"),
        best.selectExpr("threshold AS optimal_threshold"),
        best.selectExpr("f1 AS f1_at_optimal"),
    )


def session_details(scored: DataFrame, threshold: float | DataFrame, *, score: str = "score") -> DataFrame:
    """Export rows: score, less-or-equal percentile, label flags, detection flag."""
    cut = threshold.select("threshold").scalar() if isinstance(threshold, DataFrame) else F.lit(float(threshold))
    ranks = value_ranks(scored.select(score), score).selectExpr(f"{score} AS _score", "100D * upto / total AS _pct")
    return (
        scored.join(ranks, F.expr(f"{score} = _score"), "left")
        .withColumn("_cut", cut)
        .selectExpr(
            "session_id",
            "user_id",
            "start_time AS timestamp",
            f"{score} AS anomaly_score",
            "_pct AS percentile",
            "label_user = 1 AS is_insider_user",
            "label_session = 1 AS is_insider_session",
            f"{score} > _cut AS detected",
        )
    )


# ---- time to detect ----


def ttd_per_incident(
    scored: DataFrame,
    incidents: DataFrame,
    threshold: float | DataFrame,
    *,
    score: str = "score",
    by_substring: bool = False,
    slice_seconds: int = DAY,
) -> DataFrame:
    """One row per incident that has sessions in its closed window.

    Sessions meet incidents on user and time slice. The first detection and the counts are
    plain aggregates, so a large incident is not gathered anywhere. With ``by_substring``
    the user id only has to occur in the session id (for scores without a user column): every
    user id found in it takes the place of the user.
    """
    cut = threshold.select("threshold").scalar() if isinstance(threshold, DataFrame) else F.lit(float(threshold))
    user = "user_id"
    if by_substring:
        columns = list(dict.fromkeys(["session_id", "start_time", score]))
        scored, user = words_inside(scored.select(*columns), "session_id", incidents, "user_id", "_name"), "_name"
    rows = scored.withColumn("_cut", cut).selectExpr(
        "session_id",
        f"{user} AS _user",
        "start_time",
        f"{score} > _cut AS _hit",
        f"{time_bucket('start_time', slice_seconds)} AS _slice",
    )
    key = ["user_id", "inc_start", "inc_end"]
    dated = incidents.where("user_id IS NOT NULL AND inc_start IS NOT NULL AND inc_end IS NOT NULL")
    windows = dated.groupBy(*key).agg(F.expr("count(*) AS _incidents"))
    pieces = interval_slices(windows.select(*key), "inc_start", "inc_end", slice_seconds, closed=True).withColumnRenamed(
        "_slice", "_at"
    )
    inside = "_slice = _at AND _user = user_id AND start_time >= inc_start AND start_time <= inc_end"
    met = rows.join(pieces, F.expr(inside))
    first = met.groupBy(*key).agg(
        F.expr("count(*) AS total_sessions"),
        F.expr("min(CASE WHEN _hit THEN struct(start_time, session_id) END) AS _first"),
    )
    earlier = f"{inside} AND struct(start_time, session_id) < _first"
    found = pieces.join(first.where("_first IS NOT NULL").select(*key, "_first"), key)
    before = rows.join(found, F.expr(earlier)).groupBy(*key).agg(F.expr("count(*) AS _before"))
    hours = f"{hours_between('inc_start', 'inc_end')}"
    return (
        first.join(before, key, "left")
        .join(windows, key)
        .selectExpr(
            # Incidents with one user and window have equal results, a row each.
            "explode(sequence(1L, _incidents)) AS _copy",
            *key,
            f"CASE WHEN {hours} <= 0 THEN 1D ELSE {hours} END AS duration_hours",
            "total_sessions",
            "_first IS NOT NULL AS detected",
            f"CASE WHEN _first IS NOT NULL THEN {clamp_hours('inc_start', '_first.start_time')} END AS ttd_hours",
            "_first.start_time AS detected_at",
            "CASE WHEN _first IS NOT NULL THEN coalesce(_before, 0) END AS sessions_to_detect",
        )
        .drop("_copy")
        .selectExpr("*", "ttd_hours / duration_hours * 100 AS lag_pct")
    )


def last_incident_per_user(per_incident: DataFrame) -> DataFrame:
    """The export of one row per user: its last incident."""
    row = "struct(inc_start, inc_end, duration_hours, total_sessions, detected, ttd_hours, detected_at, sessions_to_detect, lag_pct)"
    return (
        per_incident.groupBy("user_id")
        .agg(F.expr(f"max_by({row}, struct(inc_start, inc_end)) AS _row"))
        .select("user_id", "_row.*")
    )


def time_to_detect(
    scored: DataFrame,
    incidents: DataFrame,
    threshold: float | DataFrame,
    *,
    score: str = "score",
    by_substring: bool = False,
) -> DataFrame:
    """One row of totals; ``n_total`` counts every incident, also those without sessions."""
    rows = ttd_per_incident(scored, incidents, threshold, score=score, by_substring=by_substring)
    # One row per incident; stored because totals and medians read it several times.
    per_incident = materialise(rows.selectExpr("*", "least(100D, greatest(0D, lag_pct)) AS lag"), "ttd")
    found = per_incident.where("detected")
    totals = found.agg(
        F.expr("count(*) AS n_detected"),
        F.expr("coalesce(avg(ttd_hours), 0D) AS ttd_hours_mean"),
        F.expr("coalesce(avg(sessions_to_detect), 0D) AS ttd_sessions_mean"),
        F.expr("coalesce(avg(lag), 0D) AS ttd_lag_mean"),
        F.expr("coalesce(100D * count_if(sessions_to_detect = 0) / nullif(count(*), 0), 0D) AS pct_first_session"),
    )
    middle = (
        exact_quantiles(unpivot(found, ["ttd_hours", "lag"]), [0.5])
        .agg(
            F.expr("max(quantile) FILTER (WHERE feature = 'ttd_hours') AS hours"),
            F.expr("max(quantile) FILTER (WHERE feature = 'lag') AS lag"),
        )
        .selectExpr("struct(hours, lag)")
        .scalar()
    )
    return (
        totals.withColumn("_middle", middle)
        .withColumn("n_total", incidents.agg(F.expr("count(*)")).scalar())
        .selectExpr(
            *totals.columns,
            "coalesce(_middle.hours, 0D) AS ttd_hours_median",
            "coalesce(_middle.lag, 0D) AS ttd_lag_median",
            "n_total",
        )
    )


# ---- reports ----

COMPARED = ("auc_roc", "f1_score", "precision", "recall")


def compare_models(metrics: DataFrame, names: Sequence[str] = COMPARED) -> DataFrame:
    """(model, level, metric, value) rows from one wide row per model and level; missing is 0."""
    pairs = ", ".join(
        f"'{n}', {f'coalesce(CAST({n} AS DOUBLE), 0D)' if n in metrics.columns else '0D'}" for n in names
    )
    return metrics.selectExpr("model", "level", f"stack({len(names)}, {pairs}) AS (metric, value)")


def merge_reports(reports: DataFrame, order_by: str, keys: Sequence[str] = ("model",)) -> DataFrame:
    """The latest report per key."""
    row = "struct(" + ", ".join(c for c in reports.columns if c not in keys) + ")"
    return reports.groupBy(*keys).agg(F.expr(f"max_by({row}, {order_by}) AS _row")).select(*keys, "_row.*")
