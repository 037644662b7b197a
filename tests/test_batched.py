import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyfield.learning import batched as Q
from tallyfield.learning import models as M
from tallyfield.learning import search as H


@pytest.fixture(scope="module")
def noisy(spark):
    """Rows with a fold and a label that three of five features tell in part."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 3, 0.5, 1, 1]
    p = 1 / (1 + np.exp(-(0.5 + x @ [1.0, -0.6, 2.0, 0, 0])))
    rows = [(*map(float, r), int(rng.random() < q), k % 4, float(1 + k % 3)) for k, (r, q) in enumerate(zip(x, p))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, y int, fold int, w double")
    return VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df).cache()


def coefficients(model):
    return [model.intercept, *model.coefficients.toArray()]


@pytest.mark.parametrize("model, params", [("logistic", {"C": 2.0}), ("logistic", {"C": 0.05, "penalty": "l1"}), ("linear", {"alpha": 0.05, "penalty": "elasticnet"}), ("linear", {"alpha": 0.3, "penalty": "l1"})])
def test_a_grid_equals_single_fits(noisy, model, params):
    n = noisy.count()
    models = [Q.Penalised(*Q.penalties(model, n, params), f) for f in (None, 0, 3)]
    theta = Q.fit_grid(Q.grid_rows(noisy, "y", "fold"), models)
    for m, got in zip(models, theta):
        train = noisy if m.fold is None else noisy.where(F.col("fold") != m.fold)
        single = M.BUILDERS[model]("y", n, **params, max_iter=500).setTol(1e-10).fit(train)
        assert got == pytest.approx(coefficients(single), abs=2e-4)


def test_expanding_folds_and_weights(noisy):
    m = [Q.Penalised(0.0, 0.01, 2)]
    theta = Q.fit_grid(Q.grid_rows(noisy, "y", "fold", "w"), m, expanding=True)
    each = noisy.where("fold < 2").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    single = M.LogisticRegression(labelCol="y", regParam=0.01, standardization=False, tol=1e-10, maxIter=500).fit(each)
    assert theta[0] == pytest.approx(coefficients(single), abs=2e-4)


def test_search_in_one_pass_scores_as_fits_one_by_one(noisy):
    for model in ("linear", "logistic"):
        best, scores = H.random_search(noisy, model, "y", 400, n_iter=6, folds=4)
        again, single = H.random_search(noisy, model, "y", 400, n_iter=6, folds=4, fixed={"max_iter": 500}, parallelism=4)
        assert {k: v for k, v in again.items() if k != "max_iter"} == {k: v for k, v in best.items() if k != "max_iter"}
        assert [(s["candidate"], s["fold"]) for s in scores] == [(s["candidate"], s["fold"]) for s in single]
        # a row on the border may fall to either side
        assert [s["score"] for s in scores] == pytest.approx([s["score"] for s in single], abs=0.011)
        assert {s["tested"] for s in scores} == {100}


def test_a_separable_label_has_finite_coefficients(spark):
    df = spark.createDataFrame([(float(k), int(k > 5), k % 2) for k in range(12)], "a double, y int, fold int")
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    theta = Q.fit_grid(Q.grid_rows(df, "y", "fold"), [Q.Penalised(0.0, 1e-4), Q.Penalised(1e-4, 0.0)])
    assert np.isfinite(theta).all()
    hits = [(theta[k, 0] + theta[k, 1] * x > 0) == (x > 5) for k in (0, 1) for x in range(12)]
    assert all(hits)


def test_no_rows():
    with pytest.raises(ValueError):
        from pyspark.sql import SparkSession

        none = SparkSession.getActiveSession().createDataFrame([], "x array<double>, y double, w double, fold int")
        Q.fit_grid(none, [Q.Penalised(0, 0)])


def test_one_model_per_key_equals_single_fits(noisy):
    keyed = noisy.withColumn("key", F.col("fold") + 10)
    rows = Q.grid_rows(keyed, "y", "key", "w").withColumnRenamed("fold", "key")
    got = {r.key: r.theta for r in Q.fit_keyed(rows, "key", l2=0.02).collect()}
    assert set(got) == {10, 11, 12, 13}
    for key, theta in got.items():
        single = M.LogisticRegression(labelCol="y", weightCol="w", regParam=0.02, standardization=False, tol=1e-10, maxIter=500).fit(keyed.where(F.col("key") == key))
        assert theta == pytest.approx(coefficients(single), abs=3e-4)


def test_shared_rows_count_for_every_key(spark):
    own = [("a", [1.0], 1.0, 5.0), ("a", [0.0], 0.0, -5.0), ("b", [1.0], 1.0, 2.0), ("b", [0.0], 1.0, 1.0), ("b", [0.0], 0.0, -3.0), (None, [1.0], 1.0, 1.0)]
    shared = [([0.0], 40.0), ([2.0], 3.0)]
    schema = "key string, x array<double>, y double, w double"
    got = Q.fit_keyed(spark.createDataFrame(own, schema), "key", spark.createDataFrame(shared, "x array<double>, w double"), l2=0.01)
    got = {r.key: r.theta for r in got.collect()}
    assert set(got) == {"a", "b", None}
    for key in got:
        rows = [(x, y, w) for k, x, y, w in own if k == key] + [(x, 0.0, w) for x, w in shared]
        merged = {}
        for x, y, w in rows:
            merged[x[0], y] = merged.get((x[0], y), 0) + w
        x, y, w = (np.array(v) for v in zip(*((a, b, c) for (a, b), c in merged.items())))
        theta = np.array(got[key])
        p = 1 / (1 + np.exp(-(theta[0] + theta[1] * x)))
        slope = np.array([(w * (p - y)).sum(), (w * (p - y) * x).sum()]) / w.sum() + [0, 0.01 * theta[1]]
        assert slope == pytest.approx([0, 0], abs=1e-6)  # where the gradient vanishes
    assert Q.fit_keyed(spark.createDataFrame([], schema), "key").collect() == []


def test_probability_by_key(spark):
    df = spark.createDataFrame([([0.5, 1.0, -2.0], 2.0, 0.25)], "theta array<double>, u double, v double")
    got = df.select(Q.keyed_probability("theta", [F.col("u"), F.col("v")])).first()[0]
    assert got == pytest.approx(1 / (1 + np.exp(-2.0)))
