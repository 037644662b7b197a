import numpy as np
import pandas as pd
import pytest

from tallyfield.operators import metrics as V


@pytest.fixture(scope="module")
def multi(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random((40, 6)), 3)
    p[3, 2], p[5, 1] = V.THRESHOLDS[7], V.THRESHOLDS[30]
    y = (rng.random((40, 6)) < 0.4).astype(int)
    y[0], p[0] = 0, 0.01  # nothing bought, nothing predicted
    rows = [(o, c, int(y[o, c]), float(p[o, c]), int(p[o, c] >= 0.5)) for o in range(40) for c in range(6)]
    return spark.createDataFrame(rows, "o int, c int, target int, probability double, prediction int"), y, p


def test_order_metrics(multi):
    df, y, p = multi
    hat = (p >= 0.5).astype(int)
    tp, union = (hat & y).sum(1), (hat | y).sum(1)
    f1 = np.where(hat.sum(1) + y.sum(1) > 0, 2 * tp / np.maximum(hat.sum(1) + y.sum(1), 1), 0.0)
    jaccard = np.where(union > 0, tp / np.maximum(union, 1), 1.0)
    got = V.basket_scores(df, ["o"], "target", "prediction").first()
    assert np.allclose(
        [got.f1_samples, got.jaccard, got.predicted_width, got.actual_width],
        [f1.mean(), jaccard.mean(), hat.sum(1).mean(), y.sum(1).mean()],
    )
    empty = [r for r in V.per_unit(df, ["o"], "target", "prediction").collect() if r.o == 0][0]
    assert (empty.f1, empty.jaccard) == (0.0, 1.0)


def test_weighted_f1(multi):
    df, y, p = multi
    hat = (p >= 0.5).astype(int)
    per = [2 * (hat[:, c] & y[:, c]).sum() / max(1, hat[:, c].sum() + y[:, c].sum()) for c in range(6)]
    want = np.average(per, weights=y.sum(0))
    assert np.isclose(V.weighted_f1(df, "c", "target", "prediction").first().f1, want)


def test_threshold_search_equals_the_loop(multi):
    df, y, p = multi
    best, gap = 0.5, float("inf")
    curve = {r.threshold: r for r in V.threshold_curve(df, ["o"], "target", "probability").collect()}
    for t in np.arange(0.05, 0.50, 0.01):
        predicted = (p >= t).sum(1).mean()
        assert np.isclose(curve[float(t)].predicted_width, predicted)
        if abs(predicted - y.sum(1).mean()) < gap:
            best, gap = t, abs(predicted - y.sum(1).mean())
    got = V.best_threshold(V.threshold_curve(df, ["o"], "target", "probability")).first()
    assert got.threshold == best and np.isclose(got.gap, gap)
    assert len(curve) == 45


def test_threshold_without_rows_is_the_default(multi):
    df = multi[0].where("false")
    assert V.best_threshold(V.threshold_curve(df, ["o"], "target", "probability")).first().threshold == 0.5


@pytest.mark.parametrize("ties", [False, True])
def test_auc_counts_pairs(spark, ties):
    rng = np.random.default_rng(12)
    y = (rng.random(300) < 0.35).astype(int)
    s = np.round(rng.random(300) + 0.3 * y, 1 if ties else 9)
    won = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
    got = V.roc_auc(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), "y", "s").first()
    assert np.isclose(got.auc, won.mean()) and (got.positives, got.negatives) == (y.sum(), 300 - y.sum())


def test_auc_of_one_class_is_null(spark):
    assert V.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first().auc is None


def test_binary_reports(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 4
    df = spark.createDataFrame(rows, "y int, p int")
    assert V.accuracy(df, "y", "p").first().accuracy == 0.75
    cells = {(r.y, r.p): (r["count"], r.error_share) for r in V.confusion(df, "y", "p").collect()}
    assert cells == {(0, 0): (5, 0.0), (0, 1): (2, 2 / 7), (1, 0): (1, 0.2), (1, 1): (4, 0.0)}
    rep = {r["class"]: r for r in V.classification_report(df, "y", "p").collect()}
    assert np.allclose([rep["1"].precision, rep["1"].recall, rep["1"].f1], [4 / 6, 4 / 5, 8 / 11])
    assert rep["macro avg"].recall == pytest.approx((5 / 7 + 4 / 5) / 2)
    assert rep["weighted avg"].f1 == pytest.approx((7 * 10 / 13 + 5 * 8 / 11) / 12)
    assert rep["accuracy"].f1 == pytest.approx(0.75) and rep["weighted avg"].support == 12


def test_class_never_predicted_scores_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    rep = {r["class"]: r for r in V.classification_report(df, "y", "p").collect()}
    assert (rep["1"].precision, rep["1"].f1) == (0.0, 0.0)


def test_fold_summary_uses_the_population_std(spark):
    rows = [("a", 0, 0, 0.5), ("a", 0, 1, 0.7), ("a", 1, 0, 0.6), ("a", 1, 1, 0.6), ("b", 0, 0, 0.1)]
    got = {r.model: r for r in V.fold_summary(spark.createDataFrame(rows, "model string, candidate int, fold int, score double")).collect()}
    assert got["a"].candidate in (0, 1) and got["a"]["mean"] == pytest.approx(0.6) and got["b"]["std"] == 0.0
