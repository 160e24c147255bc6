import random

import pytest
from checking import table

from sentrace.operators import metrics as M


def scored(spark, pairs):
    return spark.createDataFrame([(i, float(s), l) for i, (s, l) in enumerate(pairs)], "id int, score double, label int")


def brute(pairs):
    pos = [s for s, l in pairs if l == 1]
    neg = [s for s, l in pairs if l != 1]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    points = []
    for t in sorted({s for s, _ in pairs}, reverse=True):
        points.append((t, sum(s >= t for s in pos), sum(s >= t for s in neg)))
    return pos, neg, wins, points


@pytest.mark.parametrize("seed", [1, 2])
def test_curves_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40) if rng.random() < 0.6 else 7, int(rng.random() < 0.3)) for _ in range(300)]
    df = scored(spark, pairs)
    pos, neg, wins, points = brute(pairs)
    assert M.roc_auc(df).first()[0] == pytest.approx(wins / (len(pos) * len(neg)))
    got = {(r["threshold"], r["tp"], r["fp"]) for r in M.roc_curve(df).collect()}
    assert got == set(points)
    average, before = 0.0, 0
    for _, tp, fp in points:
        average += (tp - before) / len(pos) * tp / (tp + fp)
        before = tp
    assert M.average_precision(df).first()[0] == pytest.approx(average)
    best = max(
        ((2 * (tp / (tp + fp)) * (tp / len(pos)) / (tp / (tp + fp) + tp / len(pos) + 1e-8), -t) for t, tp, fp in points)
    )
    row = M.best_f1_threshold(df).first()
    assert (row["f1"], row["threshold"]) == (pytest.approx(best[0]), -best[1])


def test_straight_roc_points_are_dropped(spark):
    # Negatives only at 5, 4, 3: the middle one is on a line.
    df = scored(spark, [(6, 1), (5, 0), (4, 0), (3, 0), (2, 1)])
    got = sorted((r["threshold"], r["tpr"], round(r["fpr"], 3)) for r in M.roc_corners(df).collect())
    assert got == [(2.0, 1.0, 1.0), (3.0, 0.5, 1.0), (6.0, 0.5, 0.0), (float("inf"), 0.0, 0.0)]
    at = M.recall_at_fpr(df, [0.0, 0.4, 0.6]).orderBy("target").collect()
    assert [(r["recall"], r["threshold"]) for r in at] == [(0.0, float("inf")), (0.0, float("inf")), (0.5, 3.0)]


def test_f1_ties_take_the_lowest_threshold(spark):
    row = M.best_f1_threshold(scored(spark, [(9, 0), (8, 0)])).first()
    assert row["threshold"] == 8.0


def test_one_class(spark):
    df = scored(spark, [(1, 0), (2, 0)])
    assert M.roc_auc(df).first()[0] == 0.5
    assert M.average_precision(df).first()[0] == 0.0
    row = M.classification_metrics(df, 5.0).first()
    assert (row["tp"], row["tn"], row["precision"], row["recall"], row["f1"], row["fpr"]) == (0, 2, 0.0, 0.0, 0.0, 0.0)


def test_threshold_is_strict_unless_asked(spark):
    df = scored(spark, [(1, 0), (2, 1), (3, 1)])
    assert M.classification_metrics(df, 2.0).first()["tp"] == 1
    assert M.classification_metrics(df, 2.0, strict=False).first()["tp"] == 2


def test_precision_at_k_divides_by_k(spark):
    got = {r["k"]: r["precision"] for r in M.precision_at_k(scored(spark, [(1, 1), (1, 0), (3, 1)]), [1, 2, 10]).collect()}
    assert got == {1: 1.0, 2: 1.0, 10: 0.2}


def test_percentiles(spark):
    df = scored(spark, [(1, 0), (2, 0), (2, 0), (4, 0)])
    assert sorted(r["pct"] for r in M.anomaly_percentile(df).collect()) == [0.0, 25.0, 25.0, 75.0]
    reference = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (9.0,)], "score double")
    got = {r["id"]: r["pct"] for r in M.percentile_vs_reference(df, reference).collect()}
    assert got == {0: 25.0, 1: 25.0, 2: 25.0, 3: 75.0}
    assert {r["pct"] for r in M.percentile_vs_reference(df, None).collect()} == {50.0}
    assert {r["pct"] for r in M.percentile_vs_reference(df, reference.limit(0)).collect()} == {50.0}


def test_thresholds(spark):
    df = scored(spark, [(i, 0) for i in range(101)])
    exact = {r["p"]: r["threshold"] for r in M.score_thresholds(df).collect()}
    assert exact == {90.0: 90.0, 95.0: 95.0, 99.0: 99.0}
    rough = {r["p"]: r["threshold"] for r in M.score_thresholds(df, approx=True).collect()}
    assert all(abs(rough[p] - p) <= 1 for p in exact)


def detections(spark):
    rows = [
        ("u-1", "u", "2024-01-01 10:00", 1.0),
        ("u-2", "u", "2024-01-02 10:00", 9.0),
        ("u-3", "u", "2024-01-05 10:00", 9.0),
        ("v-1", "v", "2024-01-01 10:00", 1.0),
        ("w-1", "w", "2024-01-01 10:00", 9.0),
    ]
    return table(spark, rows, "session_id string, user_id string, start_time ntz, score double")


def incidents(spark):
    rows = [
        ("u", "2024-01-01 00:00", "2024-01-03 00:00"),
        ("u", "2024-01-02 00:00", "2024-01-12 00:00"),
        ("v", "2024-01-01 00:00", "2024-01-02 00:00"),
        ("w", "2024-01-01 10:00", "2024-01-01 10:00"),
        ("x", "2024-01-01 00:00", "2024-01-02 00:00"),
    ]
    return table(spark, rows, "user_id string, inc_start ntz, inc_end ntz")


@pytest.mark.parametrize("by_substring", [False, True])
def test_time_to_detect(spark, by_substring):
    frame = detections(spark)
    if by_substring:
        frame = frame.drop("user_id")
    rows = M.ttd_per_incident(frame, incidents(spark), 5.0, by_substring=by_substring).collect()
    got = {(r["user_id"], r["inc_start"].day): r for r in rows}
    assert set(got) == {("u", 1), ("u", 2), ("v", 1), ("w", 1)}
    first = got["u", 1]
    assert (first["total_sessions"], first["sessions_to_detect"], first["ttd_hours"]) == (2, 1, 34.0)
    assert first["lag_pct"] == pytest.approx(34 / 48 * 100)
    assert (got["u", 2]["total_sessions"], got["u", 2]["sessions_to_detect"]) == (2, 0)
    assert not got["v", 1]["detected"] and got["v", 1]["ttd_hours"] is None
    assert (got["w", 1]["duration_hours"], got["w", 1]["ttd_hours"], got["w", 1]["lag_pct"]) == (1.0, 0.0, 0.0)
    total = M.time_to_detect(frame, incidents(spark), 5.0, by_substring=by_substring).first()
    assert (total["n_detected"], total["n_total"]) == (3, 5)
    assert total["ttd_hours_mean"] == pytest.approx((34 + 10 + 0) / 3)
    assert total["ttd_hours_median"] == 10.0
    assert total["pct_first_session"] == pytest.approx(200 / 3)
    last = {r["user_id"]: r["inc_start"].day for r in M.last_incident_per_user(M.ttd_per_incident(detections(spark), incidents(spark), 5.0)).collect()}
    assert last == {"u": 2, "v": 1, "w": 1}


def test_no_detection_gives_zeros(spark):
    total = M.time_to_detect(detections(spark), incidents(spark), 99.0).first().asDict()
    assert total.pop("n_total") == 5
    assert set(total.values()) == {0}
    none = M.time_to_detect(detections(spark), incidents(spark).limit(0), 1.0).first().asDict()
    assert set(none.values()) == {0}


def test_reports(spark):
    wide = spark.createDataFrame([("m", "session", 0.5, 0.25)], "model string, level string, auc_roc double, recall double")
    got = {r["metric"]: r["value"] for r in M.compare_models(wide).collect()}
    assert got == {"auc_roc": 0.5, "f1_score": 0.0, "precision": 0.0, "recall": 0.25}
    reports = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3)], "model string, run int, x double")
    assert {(r["model"], r["x"]) for r in M.merge_reports(reports, "run").collect()} == {("a", 0.2), ("b", 0.3)}
