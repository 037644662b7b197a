import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import baskets as B
from tallyfield.plans import next_purchase as N

DIM = [(1, 10, "milk", "ok"), (2, 20, "tea", "ok"), (3, None, None, "not_found"), (4, None, None, "error"), (5, None, "lost", "ok")]
DIM_SCHEMA = "product_id bigint, category_id bigint, name string, status string"
LINE_SCHEMA = "customer_id bigint, order_id bigint, day date, product_id bigint, amount bigint"


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame(DIM, DIM_SCHEMA)


def lines_of(spark, rows):
    return spark.createDataFrame(rows, LINE_SCHEMA)


def test_category_policy(spark, dim):
    d = dt.date(2023, 1, 1)
    lines = lines_of(spark, [(1, 1, d, p, 1) for p in (1, 2, 3, 4, 5, 6)])
    kept = {r.product_id: r.category_id for r in B.apply_categories(lines, dim).collect()}
    assert kept == {1: 10, 2: 20, 3: 300112985, 5: None, 6: None}
    dropped = {r.product_id: r.category_id for r in B.apply_categories(lines, dim, delete_not_found=True).collect()}
    assert dropped == {1: 10, 2: 20, 5: None, 6: None}
    assert {(r.category_id, r.amount) for r in B.basket_long(B.apply_categories(lines, dim)).collect()} == {
        (10, 1), (20, 1), (300112985, 1),
    }


def test_status_report_and_refresh(spark, dim):
    d = dt.date(2023, 1, 1)
    lines = lines_of(spark, [(1, 1, d, p, 1) for p in (3, 3, 4, 7, 8, 9)]).withColumn("name", F.concat(F.lit("p"), "product_id"))
    got = {(r.status, r.product_id, r.name) for r in B.status_report(lines, dim).collect()}
    assert got == {("not_found", 3, "p3"), ("error", 4, "p4")}
    fetched = spark.createDataFrame([(7, 30, "jam", "ok"), (8, None, None, "not_found")], DIM_SCHEMA)
    out = {r.product_id: (r.category_id, r.status) for r in B.refresh_categories(lines, dim, fetched).collect()}
    assert out[7] == (30, "ok") and out[8] == (None, "not_found") and out[9] == (None, "error") and len(out) == 8
    assert B.refresh_counts(lines, dim, fetched).first().asDict() == {"ok": 1, "failed": 2}


def random_lines(seed, customers=6):
    rng = np.random.default_rng(seed)
    rows, order = [], 0
    start = dt.date(2023, 1, 1)
    for customer in range(customers):
        for _ in range([1, 2, 3, 4, 9, 40][customer]):  # one customer holds most orders
            order += 1
            day = start + dt.timedelta(days=int(rng.integers(0, 25)))
            for product in rng.choice([1, 2, 3, 5], size=int(rng.integers(1, 4))):
                rows.append((customer, 1000 - order * 7 % 501, day, int(product), int(rng.integers(1, 5))))
    return rows


def brute(rows, by_id, offset):
    """Dense shift per customer, as a wide table would do it."""
    category = {1: 10, 2: 20, 3: 300112985}
    frame = pd.DataFrame(rows, columns=["c", "o", "d", "p", "a"])
    days = frame.groupby(["c", "o"])["d"].min().reset_index()
    frame["cat"] = frame["p"].map(category)
    out = {}
    for c, own in days.groupby("c"):
        own = own.sort_values(["o"] if by_id else ["d", "o"])
        wide = (
            frame[(frame.c == c) & frame["cat"].notna()].pivot_table(index="o", columns="cat", values="a", aggfunc="sum")
            .reindex(index=own["o"], columns=[10, 20, 300112985]).fillna(0)
        )
        lag1, lag2, ahead = wide.shift(1).fillna(0), wide.shift(2).fillna(0), wide.shift(-offset) > 0
        gaps = pd.to_datetime(own["d"]).diff().dt.days.fillna(0).astype(int).values
        last = len(own) - offset
        for i in range(2, last):
            for cat in wide.columns:
                out[(c, own["o"].iloc[i], int(cat))] = (
                    i + 1, int(lag1[cat].iloc[i]), int(lag2[cat].iloc[i]), int(ahead[cat].iloc[i]), int(gaps[i])
                )
    return out


@pytest.mark.parametrize("by_id, offset", [(False, 1), (True, 1), (False, 0)])
def test_lags_equal_dense_shifts(spark, dim, by_id, offset):
    rows = random_lines(7)
    h = N.build_history(lines_of(spark, rows), dim, by_order_id=by_id, target_offset=offset)
    categories = sorted(r[0] for r in h.categories.collect())
    assert categories == [10, 20, 300112985]
    got = {
        (r.customer_id, r.order_id, r.category_id): (r.seq, r.lag1, r.lag2, r.target, r.days_since_last_order)
        for r in B.training_long(h.features, h.entries, h.categories, target_offset=offset).collect()
    }
    want = brute(rows, by_id, offset)
    assert got == want and len(want) > 100
    wide = B.training_wide(h.features, h.entries, h.categories, target_offset=offset).collect()
    for r in wide:
        for i, cat in enumerate(categories):
            assert (r.lag1[i], r.lag2[i], r.target[i]) == want[(r.customer_id, r.order_id, cat)][1:4]
    assert {r.customer_id for r in wide} == ({4, 5, 3} if offset else {2, 3, 4, 5})


def test_serving_uses_the_last_two_baskets(spark, dim):
    d = dt.date
    rows = [
        (1, 5, d(2023, 1, 1), 1, 9),
        (1, 4, d(2023, 1, 8), 1, 2),
        (1, 3, d(2023, 1, 15), 2, 3),
        (1, 3, d(2023, 1, 15), 1, 1),
        (2, 9, d(2023, 2, 1), 2, 4),
    ]
    h = N.build_history(lines_of(spark, rows), dim)
    got = {
        (r.customer_id, r.category_id): (r.lag1, r.lag2, r.month, r.day_of_week, r.days_since_last_order)
        for r in B.serving_rows(h.basket, h.sequence, h.categories, d(2023, 1, 25)).collect()
    }
    assert got == {
        (1, 10): (1, 2, 1, 2, 10),
        (1, 20): (3, 0, 1, 2, 10),
        (2, 10): (0, 0, 1, 2, 0),  # last order lies ahead of today
        (2, 20): (4, 0, 1, 2, 0),
    }
    width = {r.customer_id: (r.mean_width, r.n_to_show) for r in B.basket_width(h.basket, h.sequence).collect()}
    assert width[1] == (pytest.approx(4 / 3), 1) and width[2] == (1.0, 1)


def test_half_widths_round_to_even(spark):
    basket = spark.createDataFrame([(1, 1, k, 1) for k in (1, 2)] + [(1, 2, k, 1) for k in (1, 2, 3)], "customer_id int, order_id int, category_id int, amount int")
    sequence = spark.createDataFrame([(1, 1), (1, 2)], "customer_id int, order_id int")
    assert B.basket_width(basket, sequence).first()["n_to_show"] == 2


def test_orders_without_a_category_have_zero_rows(spark, dim):
    rows = [(1, i, dt.date(2023, 1, i), 5 if i == 2 else 1, 1) for i in range(1, 6)]
    h = N.build_history(lines_of(spark, rows), dim)
    got = {(r.seq, r.lag1, r.lag2, r.target) for r in B.training_long(h.features, h.entries, h.categories).collect()}
    assert got == {(3, 0, 1, 1), (4, 1, 0, 1)}


def test_more_than_ten_thousand_categories(spark):
    lines = spark.createDataFrame([(1, k, dt.date(2023, 1, k), 100 + k, 1) for k in range(1, 6)], "customer_id long, order_id long, day date, product_id long, amount long")
    basket = lines.selectExpr("customer_id", "order_id", "product_id as category_id", "amount")
    every = spark.range(100, 12_100).selectExpr("id as category_id").union(B.category_table(basket)).distinct()
    sequence = B.sequence_orders(lines)
    rows = B.training_long(B.order_features(sequence), B.lag_entries(basket, sequence), every)
    assert rows.count() == 2 * 12_000
    assert rows.agg(F.sum("lag1"), F.sum("target")).first()[:] == (2, 2)
    assert B.serving_rows(basket, sequence, every, dt.date(2023, 2, 1)).count() == 12_000


def test_wide_basket_and_top_categories(spark):
    basket = spark.createDataFrame([(1, 1, 10, 4), (1, 2, 20, 5)], "customer_id int, order_id int, category_id int, amount bigint")
    assert sorted(tuple(r) for r in B.basket_wide(basket, [10, 20, 30]).collect()) == [(1, 1, 4, 0, 0), (1, 2, 0, 5, 0)]
    entries = spark.createDataFrame([(10, 1), (10, 1), (20, 1), (20, 1), (30, 1)], "category_id int, target int")
    assert [r.category_id for r in B.top_categories(entries, spark.range(20).selectExpr('id as category_id')).collect()] == [10, 20]
    assert [r.category_id for r in B.top_categories(entries, spark.range(3).selectExpr('id as category_id')).collect()] == [10]


def test_examples_and_ranking(spark, dim):
    products = spark.createDataFrame([(i, 10, f"n{i}") for i in (4, 2, 3, 1)] + [(9, 20, None), (8, None, "x")], "product_id bigint, category_id bigint, name string")
    got = {r.category_id: (r.example_1, r.example_2, r.example_3, r.id_product_1, r.id_product_3) for r in B.category_examples(products).collect()}
    assert got == {10: ("n1", "n2", "n3", 1, 3), 20: (None, None, None, 9, None)}
    scored = spark.createDataFrame([(1, 10, 0.4), (1, 20, 0.9), (1, 30, 0.4), (1, 40, 0.1), (2, 10, 0.2)], "customer_id int, category_id int, probability double")
    show = spark.createDataFrame([(1, 2), (2, 5)], "customer_id int, n_to_show int")
    ranked = B.rank_suggestions(scored, 0.3, show).collect()
    assert sorted((r.customer_id, r["rank"], r.category_id) for r in ranked) == [(1, 1, 20), (1, 2, 10)]
