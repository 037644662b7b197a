import datetime as dt

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyfield.learning import models as M
from tallyfield.learning import search as H
from tallyfield.learning.transforms import fit_features
from tallyfield.operators import cells as G
from tallyfield.operators import imputation as I
from tallyfield.operators import splits as X
from tallyfield.plans import next_purchase as N
from tallyfield.plans import records as R


def test_ranges_keep_their_bounds():
    rng = np.random.RandomState(0)
    ints = {H.IntRange(3, 8).draw(rng) for _ in range(500)}
    assert ints == {3, 4, 5, 6, 7}
    flat = [H.Uniform(0.5, 0.3).draw(rng) for _ in range(500)]
    assert 0.5 <= min(flat) and max(flat) <= 0.8
    logs = [H.LogUniform(0.001, 0.1).draw(rng) for _ in range(2000)]
    assert 0.001 <= min(logs) and max(logs) <= 0.1 and abs(np.median(logs) - 0.01) < 0.002


def test_candidates_repeat_with_the_seed():
    for ranges in [*H.FIRST_RANGES.values(), H.PURCHASE_RANGES]:
        assert H.sample(ranges, 5) == H.sample(ranges, 5) != H.sample(ranges, 5, seed=7)


def test_second_stage_ranges_lie_around_the_best():
    best = {"n_estimators": 150, "max_depth": 2, "learning_rate": 0.04, "subsample": 0.55}
    got = H.second_ranges("boosting", best)
    assert got["n_estimators"] == H.IntRange(100, 350) and got["max_depth"] == H.IntRange(2, 3)
    assert got["learning_rate"] == H.Uniform(0.02, 0.04) and got["subsample"] == H.Uniform(0.5, 0.2)
    xs = H.second_ranges("stopped_boosting", {"colsample_bytree": 0.95, "min_child_weight": 2, "max_depth": 4})
    assert xs["colsample_bytree"].low == pytest.approx(0.85) and xs["colsample_bytree"].width == pytest.approx(0.15)
    assert xs["min_child_weight"] == H.IntRange(1, 5) and xs["max_depth"] == H.IntRange(3, 6)
    assert H.second_ranges("logistic", {"penalty": "l1", "C": 2.0}) == {"penalty": H.OneOf(("l1",)), "C": H.Uniform(1.0, 3.0)}


def test_best_candidate_is_the_earliest_on_ties():
    scores = [{"candidate": c, "fold": f, "score": s} for c, f, s in [(0, 0, 0.5), (0, 1, 0.7), (1, 0, 0.6), (1, 1, 0.6), (2, 0, 0.1)]]
    assert H.best_of(scores) == 0


@pytest.fixture(scope="module")
def planted(spark):
    """A label that follows x and the colour, with gaps in the colour."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=240)
    colour = rng.choice(["blue", "it's red", "green"], 240)
    y = ((x + (colour == "blue") + rng.normal(size=240) * 0.3) > 0.3).astype(int)
    rows = [(i, float(v), None if i % 17 == 0 else str(c), int(k)) for i, (v, c, k) in enumerate(zip(x, colour, y))]
    df = spark.createDataFrame(rows, "id int, x double, colour string, y int")
    folded = X.stratified_folds(df, "y", ["id"])
    fitted = fit_features(folded, ["x"], ["colour"])
    return df, fitted, fitted.transform(folded).select("id", "y", "fold", "features").cache()


def test_feature_vector(planted, spark, tmp_path):
    df, fitted, known = planted
    x = df.toPandas().x
    first = known.orderBy("id").first().features
    assert first.size == 4 and np.isclose(first[0], (x[0] - x.mean()) / x.std(ddof=0)) and first[1:].sum() == 1
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df).orderBy("id").first().features
    assert np.allclose(again.toArray(), first.toArray())
    with pytest.raises(Exception):
        fitted.transform(spark.createDataFrame([(1, 0.0, "pink", 0)], df.schema)).collect()


@pytest.mark.parametrize("name", ["logistic", "random_forest", "extra_trees", "boosting", "stopped_boosting", "regularised_boosting"])
def test_models_beat_the_majority(planted, name):
    params = {"n_estimators": 6, "max_depth": 3} if name != "logistic" else {"C": 10.0, "penalty": "l1"}
    train, test = H.fold_parts(planted[2], 0, "fold", expanding=False)
    scored = M.score(M.BUILDERS[name]("y", 200, **params).fit(train), test).collect()
    assert len(scored) == test.count() == len({r.id for r in scored})
    assert all(0 <= r.probability <= 1 and r.prediction in (0, 1) for r in scored)
    right = np.mean([r.prediction == r.y for r in scored])
    assert right > max(np.mean([r.y for r in scored]), 1 - np.mean([r.y for r in scored])) + 0.1


def test_two_stage_search_scores_every_fold(planted):
    best, scores = H.two_stage_search(planted[2], "linear", "y", 240, n_iter=2, fixed={"max_iter": 20}, folds=2)
    assert len(scores) == 4 and {s["fold"] for s in scores} == {0, 1}
    assert best["penalty"] in ("l1", "l2", "elasticnet") and all(0 <= s["score"] <= 1 for s in scores)


def test_expanding_folds_never_train_on_later_rows(spark):
    df = spark.range(1, 25).selectExpr("id as place", "24L as n_rows")
    folded = X.time_series_folds(df)
    for fold in range(5):
        train, test = H.fold_parts(folded, fold, "test_fold", expanding=True)
        assert train.agg(F.max("place")).first()[0] < test.agg(F.min("place")).first()[0]


def test_votes(spark):
    df = spark.createDataFrame([(0.4, 0.6, 1, 0, 1, 0), (0.9, 0.3, 1, 1, 1, 0), (0.1, 0.2, 0, 0, 1, 0)], "a double, b double, p int, q int, r int, s int")
    assert [r.prediction for r in I.soft_vote(df, ["a", "b"]).collect()] == [0, 1, 0]
    assert [r.prediction for r in I.hard_vote(df, ["p", "q", "r", "s"]).collect()] == [0, 1, 0]


def test_voting_folds_and_submission(planted):
    _, _, known = planted
    params = {"linear": {}, "logistic": {"C": 10.0}}
    scores = R.compare_models(known, "y", 240, params, folds=2)
    assert list(scores) == ["linear", "logistic", "soft_vote", "hard_vote"]
    for part in scores.values():
        assert [s["fold"] for s in part] == [0, 1] and all(s["score"] > 0.6 for s in part)
    models = R.fit_models(known, "y", 240, params)
    assert R.vote(models, known, "hard").where("prediction not in (0, 1)").count() == 0
    out = R.submission(models["logistic"], known.drop("y"), "id", "y")
    assert out.columns == ["id", "y"] and out.select("id").distinct().count() == 240


def test_passenger_features(spark):
    rows = [
        (1, 1, 3, "Heron, Mr. A", "male", 20.0, 1, 0, "t1", 7.0, None, "S"),
        (2, 0, 3, "Heron, Capt. B", "male", None, 0, 0, "t1", None, "C85", "S"),
        (3, 0, 3, "Heron, Mr. C", "male", 30.0, 0, 2, "t2", 9.0, "", None),
        (4, 1, 1, "no title", "female", None, 0, 0, None, 80.0, "B1 B2", "Q"),
    ]
    df = spark.createDataFrame(
        rows,
        "PassengerId bigint, Survived int, Pclass bigint, Name string, Sex string, Age double, SibSp bigint, Parch bigint,"
        " Ticket string, Fare double, Cabin string, Embarked string",
    )
    ready = R.fill_fare(R.passenger_features(df), df)
    got = {r.PassengerId: (r.Deck, r.FamilySize, r.Title, r.Age, r.TicketGroupSize, r.Fare) for r in ready.collect()}
    assert got == {
        1: ("U", 2, "Mr", 20.0, 2, 7.0),
        2: ("C", 1, "Rare", 25.0, 2, 8.0),
        3: ("U", 3, "Mr", 30.0, 1, 9.0),
        4: ("B", 1, None, None, None, 80.0),
    }
    assert not {"Name", "Cabin", "SibSp", "Parch", "Ticket"} & set(ready.columns)


@pytest.fixture(scope="module")
def habit(spark):
    """Customers who alternate between two categories: the next order is known from the last ones."""
    rows = []
    for customer in range(6):
        for i in range(24):
            product = 1 if (i + customer) % 2 else 2
            rows.append((customer, customer * 100 + i, dt.date(2023, 1, 1) + dt.timedelta(days=7 * i + customer), product, 2))
    lines = spark.createDataFrame(rows, "customer_id bigint, order_id bigint, day date, product_id bigint, amount bigint")
    dim = spark.createDataFrame([(1, 10, "milk", "ok"), (2, 20, "tea", "ok")], "product_id bigint, category_id bigint, name string, status string")
    return lines, dim


PARAMS = {"max_depth": 3, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0, "min_child_weight": 1}


def test_next_purchases_learn_the_habit(habit):
    lines, dim = habit
    # lags and target line up when the target is the position itself
    h = N.build_history(lines, dim, target_offset=0)
    t = N.training_set(h, test_size=0.1)
    score = N.model_scorer(N.fit_pooled(t, PARAMS, trees=8))
    threshold = N.tuned_threshold(t.grid("val").scored(score))
    quality = N.evaluate(t.grid("test").scored(score), threshold).first()
    assert quality.f1_samples > 0.95 and quality.jaccard > 0.95
    served = N.serving(h, t, dt.date(2023, 7, 1))
    got = N.suggest(served, score, threshold, h, dim).collect()
    assert {(r.customer_id, r.category_id) for r in got} == {(c, 10 if (24 + c) % 2 else 20) for c in range(6)}
    lines_out = N.report_lines(N.suggest(served, score, threshold, h, dim), served.heads)
    heads = lines_out.where("rank = 0").collect()
    assert len(heads) == 6 and all(r.line.startswith("Last order : 2023-06-") for r in heads)


def test_search_on_top_categories(habit):
    lines, dim = habit
    h = N.build_history(lines, dim)
    best, scores = N.search_parameters(N.training_set(h), h, n_iter=2, folds=2, trees=2)
    assert set(best) == set(H.PURCHASE_RANGES) and len(scores) == 4


def test_whole_job_with_defaults(habit):
    lines, dim = habit
    got = N.next_purchases(lines, dim, dt.date(2023, 7, 1), trees=3, params=PARAMS, n_to_show=1)
    assert {r["rank"] for r in got.collect()} == {1}
    assert {"example_1", "example_3", "id_product_1", "id_product_3", "probability"} <= set(got.columns)


def test_the_whole_job_fits_on_every_cell(spark, tmp_path, monkeypatch):
    """The query's search and fit read all cells of their orders, whatever the bound of other queries is."""
    from tallyfield.bindings import modelled
    from tallyfield.bindings.registry import QUERIES
    from tallyfield.bindings.tables import SCHEMAS

    types = ["ECONOMY", "LARGE", "MEDIUM"]
    parts = [(k, f"n{k}", "b", types[k % 3], 1, 1.0) for k in range(1, 10)]
    orders = [(c * 100 + i, c, "O", 1.0, dt.datetime(2023, 1, 1) + dt.timedelta(days=5 * i + c), "1") for c in range(1, 9) for i in range(9)]
    lines = [(o[0], (o[0] * j) % 9 + 1, 1, j, float(j), 1.0, 0.0, 0.0, "N", "O", o[4]) for o in orders for j in (1, 2)]
    for name, rows in (("part", parts), ("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    fits, searched = [], []
    fit, boosting = N.patient_boosting, N.weighted_boosting
    monkeypatch.setattr(modelled, "FIT_ROWS", 5)
    monkeypatch.setattr(N, "patient_boosting", lambda df, *a, **k: fits.append(df.agg(F.sum("weight")).first()[0]) or fit(df, *a, **k))
    monkeypatch.setattr(N, "weighted_boosting", lambda df, *a, **k: searched.append(df.agg(F.sum("weight")).first()[0]) or boosting(df, *a, **k))
    QUERIES["next_purchases"](spark, str(tmp_path)).collect()
    # 8 customers with 6 trained orders each; 9 of the 48 are validated, the others make folds of 6 after the first 9
    assert fits == [48 * 3]
    assert sorted(searched) == sorted(2 * [9, 15, 21, 27, 33])


def test_the_best_round_is_kept():
    losses = [0.9, 0.8, 0.81, 0.79, 0.85, 0.7, 0.9, 0.9, 0.9, 0.1]
    assert M.best_round(losses, 2) == 6
    assert M.best_round(losses, 4) == 10
    assert M.best_round([0.5], 20) == 1


def test_patience_goes_on_where_a_tolerance_stops(habit):
    lines, dim = habit
    t = N.training_set(N.build_history(lines, dim, target_offset=0), test_size=0.1)
    slow = {**PARAMS, "learning_rate": 0.01, "max_depth": 2}
    fitted = t.cells.where("role in ('train', 'val')")
    early = M.stopped_boosting("target", 0, n_estimators=30, validation="is_val", validation_tol=0.05, **slow).fit(fitted)
    patient = M.patient_boosting(fitted, "target", "is_val", 30, 20, slow, weight="weight")
    assert early.getNumTrees < 30 == patient.getNumTrees


def test_weights_stand_for_rows(spark):
    rows = [(float(x), y, w) for x, y, w in ((0, 0, 30.0), (0, 1, 3.0), (1, 1, 20.0), (1, 0, 5.0), (2, 0, 2.0))]
    cells = spark.createDataFrame(rows, "x double, y int, weight double")
    vector = VectorAssembler(inputCols=["x"], outputCol="features").transform(cells)
    each = vector.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    params = {"max_depth": 2, "n_estimators": 4, "learning_rate": 0.5}
    plain = M.stopped_boosting("y", 0, **params).fit(each)
    weighted = M.weighted_boosting(vector, "y", "weight", **params).fit(vector)
    scores = [{r.x: r.probability for r in M.score(m, vector).select("x", "probability").distinct().collect()} for m in (plain, weighted)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)
    assert weighted.evaluateEachIteration(vector) == pytest.approx(weighted.evaluateEachIteration(each.withColumn("weight", F.lit(1.0))))
    # a child of weight 2 is too small if 3 are asked for
    few = M.weighted_boosting(vector, "y", "weight", min_child_weight=3, **params).fit(vector)
    got = {r.x: r.probability for r in M.score(few, vector).select("x", "probability").distinct().collect()}
    assert got[1.0] == got[2.0] != scores[1][2.0]
    parts = M.spread(vector, "weight", 8)
    assert parts.groupBy("x", "y").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).where("n > 8 or w < 1").isEmpty()
    assert parts.agg(F.sum("weight")).first()[0] == 60


def test_bounded_rows(spark):
    df = spark.range(10_000)
    assert M.bounded(df, 20_000, "id").count() == 10_000
    assert 700 < M.bounded(df, 1_000, "id").count() < 1_300


def test_record_job(planted):
    _, _, known = planted
    small = {m: {"n_estimators": 3, "max_depth": 2} for m in ("random_forest", "extra_trees", "boosting", "regularised_boosting")}
    small |= {m: {"max_iter": 20} for m in ("linear", "logistic")}
    job = R.record_job(known, known.drop("y"), "id", "y", n_iter=1, fixed=small, folds=2)
    names = {*M.COMPARED, "soft_vote", "hard_vote"}
    assert {r.model for r in job.comparison.collect()} == names == set(job.reports)
    assert job.submission.count() == 240 and job.submission.columns == ["id", "y"]
    assert all(r.count() >= 4 for r in job.reports.values())


def test_report_and_sinks(habit, spark, tmp_path):
    lines, dim = habit
    h = N.build_history(lines, dim, target_offset=0)
    t = N.training_set(h, test_size=0.1)
    model = N.fit_pooled(t, PARAMS, trees=8)
    score, served = N.model_scorer(model), N.serving(h, t, dt.date(2023, 7, 1))
    shown = N.suggest(served, score, 0.5, h, dim)
    text = N.report_lines(shown, served.heads, G.predicted_counts(served.heads, served.own, served.rates, score, 0.5))
    N.write_suggestions(shown, text, str(tmp_path / "table"), str(tmp_path / "text"))
    assert spark.read.option("header", True).csv(str(tmp_path / "table")).count() == 6
    written = [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert sum(v == "Showing top 1 categories, out of 1 predicted" for v in written) == 6 and len(written) == 18
    quality = N.compare_thresholds(t, model).collect()
    assert len(quality) == 2 and all(r.f1_samples > 0.9 for r in quality)
