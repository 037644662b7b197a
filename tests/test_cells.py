import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import baskets as B
from tallyfield.operators import cells as G
from tallyfield.operators import metrics as V
from tallyfield.plans import next_purchase as N


def formula(cells):
    """A score of all that a model sees."""
    code = F.col("month") * 5 + F.col("day_of_week") * 3 + F.col("days_since_last_order") + F.col("lag1") * 7 + F.col("lag2") * 2
    return cells.withColumn("probability", ((code + F.floor(F.col(G.LEVEL) * 1000)) % 20) / 20.0)


@pytest.fixture(scope="module")
def grid(spark):
    """Orders of customers with few and many orders over 12 categories, two of which nobody ever bought."""
    rng = np.random.default_rng(11)
    rows, day = [], dt.date(2024, 1, 1)
    for customer in range(1, 9):
        for k in range([3, 4, 5, 6, 8, 10, 15, 40][customer - 1]):
            for category in rng.choice(10, size=int(rng.integers(1, 5)), replace=False, p=np.arange(10, 0, -1) / 55):
                rows.append((customer, customer * 100 + k, day + dt.timedelta(days=int(7 * k + rng.integers(0, 4))), int(category) + 1, int(rng.integers(1, 4))))
    lines = spark.createDataFrame(rows, "customer_id long, order_id long, day date, product_id long, amount long")
    dim = spark.createDataFrame([(k, k * 10, f"n{k}", "ok") for k in range(1, 13)], "product_id long, category_id long, name string, status string")
    every = spark.createDataFrame([(k * 10,) for k in range(1, 13)], "category_id long")
    h = N.build_history(lines, dim, categories=every)
    orders = h.features.where(B.trained_positions()).cache()
    rates = G.category_levels(h.categories, h.entries, orders).cache()
    dense = B.training_long(h.features, h.entries, h.categories).join(rates, "category_id").cache()
    return h, orders, rates, dense


def test_weighted_cells_stand_for_every_cell(grid):
    h, orders, rates, dense = grid
    names = [*G.CALENDAR, "lag1", "lag2", "target", G.LEVEL]
    want = {tuple(r[:-1]): r[-1] for r in dense.groupBy(*names).count().collect()}
    cells = G.training_cells(orders, h.entries, rates).select(*names, "weight").collect()
    assert {tuple(r[:-1]): r[-1] for r in cells} == want and len(cells) == len(want)
    marked = G.training_cells(orders.withColumn("late", F.col("seq") > 6), h.entries, rates, ["late"])
    sums = {r.late: r.w for r in marked.groupBy("late").agg(F.sum("weight").alias("w")).collect()}
    assert sums == {r.late: r["count"] for r in dense.withColumn("late", F.col("seq") > 6).groupBy("late").count().collect()}


@pytest.mark.parametrize("threshold", [0.0, 0.25, 0.5, 0.95, 2.0])
def test_scores_equal_those_of_the_dense_rows(grid, threshold):
    h, orders, rates, dense = grid
    scored = G.score_cells(orders, h.entries, rates, formula)
    rows = formula(dense).withColumn("prediction", (F.col("probability") >= threshold).cast("int"))
    want = {(r.customer_id, r.order_id): tuple(r[2:]) for r in V.per_unit(rows, ["customer_id", "order_id"], "target", "prediction").collect()}
    got = {(r.customer_id, r.order_id): tuple(r[2:]) for r in G.unit_scores(scored, threshold).collect()}
    assert got == want
    want = {r.category_id: tuple(r[1:]) for r in V.label_f1(rows, "category_id", "target", "prediction").collect()}
    assert {r.category_id: tuple(r[1:]) for r in G.category_f1(scored, threshold).collect()} == want
    assert V.weigh_f1(G.category_f1(scored, threshold)).first() == V.weighted_f1(rows, "category_id", "target", "prediction").first()


def test_curve_and_threshold_equal_those_of_the_dense_rows(grid):
    h, orders, rates, dense = grid
    curve = G.threshold_curve_of(G.score_cells(orders, h.entries, rates, formula))
    want = V.threshold_curve(formula(dense), ["customer_id", "order_id"], "target", "probability")
    assert sorted(curve.collect()) == sorted(want.collect())
    assert V.best_threshold(curve).first() == V.best_threshold(want).first()


@pytest.mark.parametrize("threshold, n", [(0.0, None), (0.3, None), (0.6, 4), (0.0, 12), (0.0, 50), (0.3, 0)])
def test_merged_lists_equal_ranking_every_category(grid, threshold, n):
    h, _, rates, _ = grid
    today = dt.date(2024, 12, 2)
    show = B.basket_width(h.basket, h.sequence)
    if n is not None:
        show = show.withColumn("n_to_show", F.lit(n))
    dense = formula(B.serving_rows(h.basket, h.sequence, h.categories, today).join(rates, "category_id"))
    ranked = B.rank_suggestions(dense, threshold, show)
    heads, own = G.serving_heads(h.sequence, today), G.serving_cells(h.basket, h.sequence)
    got = G.merged_suggestions(heads, own, rates, formula, threshold, show)
    columns = ["customer_id", "category_id", "probability", "rank", "n_to_show"]
    assert sorted(got.select(*columns).collect()) == sorted(ranked.select(*columns).collect())
    counts = {r.customer_id: r.n_predicted for r in G.predicted_counts(heads, own, rates, formula, threshold).collect()}
    want = dense.groupBy("customer_id").agg(F.count_if(F.col("probability") >= threshold).alias("n")).collect()
    assert counts == {r.customer_id: r.n for r in want}


def test_twenty_thousand_categories_make_no_grid(spark):
    lines = spark.createDataFrame([(c, c * 10 + k, dt.date(2023, 1, k + c), 100 + k % 3, 1) for c in (1, 2) for k in range(1, 7)], "customer_id long, order_id long, day date, product_id long, amount long")
    basket = lines.selectExpr("customer_id", "order_id", "product_id as category_id", "amount")
    every = spark.range(20_000).selectExpr("id as category_id")
    sequence = B.sequence_orders(lines)
    orders = B.order_features(sequence).where(B.trained_positions())
    entries = B.lag_entries(basket, sequence)
    rates = G.category_levels(every, entries, orders)
    cells = G.training_cells(orders, entries, rates)
    assert cells.agg(F.sum("weight")).first()[0] == orders.count() * 20_000
    assert cells.count() < 40
    scored = G.score_cells(orders, entries, rates, formula)
    widths = G.unit_scores(scored, 0.0)
    assert {r.tp + r.fp for r in widths.collect()} == {20_000}
    heads, own = G.serving_heads(sequence, dt.date(2023, 2, 1)), G.serving_cells(basket, sequence)
    shown = G.merged_suggestions(heads, own, rates, formula, 0.0, B.basket_width(basket, sequence).withColumn("n_to_show", F.lit(7)))
    assert sorted((r.customer_id, r["count"]) for r in shown.groupBy("customer_id").count().collect()) == [(1, 7), (2, 7)]
    # every table between the jobs is small too
    tables = [scored.present, scored.groups, G.absent_cells(orders, G.present_cells(orders, entries, rates), rates, G.CALENDAR)]
    assert max(t.count() for t in tables) < 40


def test_levels_are_few_and_empty_tables_stay_empty(spark):
    shares = [0.0, 1e-12, 1e-9, 0.00123456, 0.5, 0.0999999, 1.0, 1 / 3]
    df = spark.createDataFrame([(x,) for x in shares], "x double").select("x", G.rate_level(F.col("x")).alias("level"))
    for r in df.collect():
        want = 0.0 if r.x < 1e-9 else float(f"{r.x:.1e}")
        assert r.level == pytest.approx(want, rel=1e-12, abs=0)
    assert math.isclose(df.where("x = 0.00123456").first().level, 0.0012)
    none = spark.createDataFrame([], "customer_id long, order_id long, seq int, month int, day_of_week int, days_since_last_order int")
    entries = spark.createDataFrame([], "customer_id long, seq int, category_id long, lag1 long, lag2 long, target int")
    rates = G.category_levels(spark.createDataFrame([(1,)], "category_id long"), entries, none)
    assert [tuple(r) for r in rates.collect()] == [(1, 0.0)]
    assert G.training_cells(none, entries, rates).collect() == []
    assert V.best_threshold(G.threshold_curve_of(G.score_cells(none, entries, rates, formula))).first()["threshold"] == 0.5


def test_training_cells_join_the_entries_once(spark):
    """The absent cells are counted from the written present ones, whose weights may be above one."""
    orders = spark.createDataFrame([(k, 3, 1, 2, 7) for k in range(5)], "customer_id bigint, seq int, month int, day_of_week int, days_since_last_order int")
    entries = spark.createDataFrame([(k, 3, 1, 4, 0, 1) for k in range(3)], "customer_id bigint, seq int, category_id bigint, lag1 bigint, lag2 bigint, target int")
    rates = spark.createDataFrame([(1, 0.5), (2, 0.5)], f"category_id bigint, {G.LEVEL} double")
    got = G.training_cells(orders, entries, rates)
    assert sorted((r.lag1, r.target, r.weight) for r in got.collect()) == [(0, 0, 7), (4, 1, 3)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lag1" in x for x in plan.splitlines() if "LogicalRDD" in x or "LocalRelation" in x)


def joins(df):
    return sum(" Join " in f" {x.lstrip(' +-:')}" for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_counted_cells_are_scored_once_for_the_curve(grid):
    """A grid whose cells are counted gives the same curve and scores, and scores its distinct cells for the curve."""
    h, orders, rates, _ = grid
    entries = G.placed_entries(orders, h.entries)
    counted = G.training_cells(orders, entries, rates)
    seen = []
    scored = G.open_grid(orders, entries, rates, counted=counted).scored(lambda cells: seen.append(cells.count()) or formula(cells))
    want = G.score_cells(orders, h.entries, rates, formula)
    assert sorted(G.threshold_curve_of(scored).collect()) == sorted(G.threshold_curve_of(want).collect())
    assert seen == [counted.count()]
    for of in (G.unit_scores, G.category_f1):
        assert sorted(of(scored, 0.4).collect()) == sorted(of(want, 0.4).collect())


def test_entries_and_baskets_are_placed_once(grid, spark):
    """Placed entries and baskets give the same tables without a further join with the orders."""
    h, orders, rates, _ = grid
    late = orders.where("seq > 6")
    entries = G.placed_entries(late, h.entries)
    pairs = [(G.category_levels(h.categories, e, late), G.training_cells(late, e, rates)) for e in (entries, h.entries)]
    for placed, plain in zip(*pairs):
        assert sorted(placed.select(sorted(placed.columns)).collect()) == sorted(plain.select(sorted(plain.columns)).collect())
    stored = spark.createDataFrame(entries.collect(), entries.schema)
    assert joins(G.present_cells(late, stored, rates)) == joins(G.present_cells(late, h.entries, rates)) - joins(h.entries) - 1
    basket = B.placed_basket(h.basket, h.sequence)
    basket = spark.createDataFrame(basket.collect(), basket.schema)
    for of in (B.lag_entries, G.serving_cells):
        placed, plain = of(basket, h.sequence), of(h.basket, h.sequence)
        assert joins(placed) == 0 < joins(plain) and sorted(placed.collect()) == sorted(plain.collect())


def test_counts_of_predictions_build_the_history_once(spark, monkeypatch):
    from tallyfield.bindings import purchases

    built, once = [], purchases.build_history
    monkeypatch.setattr(purchases, "build_history", lambda *a, **k: built.append(1) or once(*a, **k))
    purchases.merged(spark, "/root/testdata/sf0.001")
    assert len(built) == 1
