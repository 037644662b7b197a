import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import baskets as B
from tallyfield.operators import metrics as V
from tallyfield.plans import category_models as C

from test_cells import grid  # noqa: F401


@pytest.fixture(scope="module")
def fitted(grid):  # noqa: F811
    h, orders, _, dense = grid
    models = C.fit_category_models(orders, h.entries, l2=0.01).cache()
    rows = dense.join(models, "category_id", "left")
    p = C.keyed_probability("theta", C.features(F.col("lag1"), F.col("lag2")))
    return h, orders, models, rows.withColumn("probability", F.coalesce(p, F.lit(0.0))).cache()


def test_models_stand_where_the_gradient_over_all_cells_vanishes(fitted):
    h, _, models, dense = fitted
    x = F.array(*C.features(F.col("lag1"), F.col("lag2")))
    cells = dense.select("category_id", x.alias("x"), "target").collect()
    thetas = {r.category_id: np.array(r.theta) for r in models.collect()}
    assert set(thetas) == {r[0] for r in h.entries.select("category_id").distinct().collect()} and len(thetas) >= 8
    for category, theta in thetas.items():
        own = [r for r in cells if r.category_id == category]
        a, y = np.array([[1.0, *r.x] for r in own]), np.array([r.target for r in own])
        p = 1 / (1 + np.exp(-a @ theta))
        slope = a.T @ (p - y) / len(own) + 0.01 * theta * ([0] + [1] * 7)
        assert slope == pytest.approx(np.zeros(8), abs=1e-5)


@pytest.mark.parametrize("threshold", [0.0001, 0.1, 0.3, 0.5])
def test_scores_equal_those_of_the_dense_rows(fitted, threshold):
    h, orders, models, dense = fitted
    scored = C.score_categories(models, orders, h.entries)
    known = dense.withColumn("prediction", ((F.col("probability") >= threshold) & F.col("theta").isNotNull()).cast("int"))
    want = {(r.customer_id, r.order_id): tuple(r[2:]) for r in V.per_unit(known, ["customer_id", "order_id"], "target", "prediction").collect()}
    assert {(r.customer_id, r.order_id): tuple(r[2:]) for r in C.unit_scores(scored, threshold).collect()} == want
    listed = known.join(models.select("category_id"), "category_id", "left_semi")
    want = {r.category_id: tuple(r[1:]) for r in V.label_f1(listed, "category_id", "target", "prediction").collect()}
    assert {r.category_id: tuple(r[1:]) for r in C.category_f1(scored, threshold).collect()} == want


def test_curve_equals_that_of_the_dense_rows(fitted):
    h, orders, models, dense = fitted
    scored = C.score_categories(models, orders, h.entries)
    want = V.threshold_curve(dense, ["customer_id", "order_id"], "target", "probability")
    assert sorted(C.threshold_curve_of(scored).collect()) == sorted(want.collect())
    assert C.tuned_threshold(scored) == V.best_threshold(want).first()["threshold"]


def test_no_orders(spark, fitted):
    h, orders, models, _ = fitted
    none = orders.limit(0)
    assert C.fit_category_models(none, h.entries).collect() == []
    scored = C.score_categories(models, none, h.entries)
    assert C.unit_scores(scored, 0.5).collect() == [] and C.tuned_threshold(scored) == 0.5


def test_gaps_beyond_a_year_count_the_same(spark):
    assert B.LineColumns() == C.LINES
    orders = spark.createDataFrame([(1, 1, 3, 5, 2, 400), (1, 2, 4, 5, 2, 9000), (1, 3, 5, 5, 2, 10)], "customer_id long, order_id long, seq int, month int, day_of_week int, days_since_last_order int")
    assert sorted(tuple(r) for r in C.calendars(orders).collect()) == [(5, 2, 10, 1), (5, 2, 366, 2)]


def test_cells_are_counted_once_before_the_fit(spark, monkeypatch):
    orders = spark.createDataFrame([(k, 3, 1, 2, 7) for k in range(5)], "customer_id bigint, seq int, month int, day_of_week int, days_since_last_order int")
    entries = spark.createDataFrame([(k, 3, 1, 4, 0, 1) for k in range(3)], "customer_id bigint, seq int, category_id bigint, lag1 bigint, lag2 bigint, target int")
    seen = []
    monkeypatch.setattr(C, "fit_keyed", lambda rows, *a: seen.append(rows))
    C.fit_category_models(orders, entries)
    assert sorted((r.y, r.w) for r in seen[0].collect()) == [(0.0, -3.0), (1.0, 3.0)]
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
