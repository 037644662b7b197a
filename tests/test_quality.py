import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import quality as Q
from tallyfield.plans.audit import audit_report

D = dt.date
SCHEMA = "article_id bigint, site_id bigint, zone_id bigint, day date, quantity double, price bigint, cost_price bigint"
ROWS = [
    (1, 4, 1, D(2019, 1, 1), 2.0, 10, 8),
    (1, 4, 1, D(2019, 1, 1), 3.0, 11, 8),  # price conflict, duplicate key
    (1, 4, 1, D(2019, 1, 1), 1.0, 10, 8),  # third member of the duplicate
    (1, 5, 1, D(2019, 1, 2), 2.0, 10, None),  # missing cost
    (1, 5, 1, D(2019, 1, 2), 2.0, None, 9),  # {10, null} is no conflict
    (2, 9, 1, D(2019, 2, 1), 0.0, 5, 5),  # unknown site, zero quantity, margin 0
    (2, 4, 2, D(2019, 2, 2), -1.0, 5, 6),  # wrong zone, negative quantity and margin
    (3, 5, 1, D(2019, 3, 1), 1.5, 7, 1),  # unknown article, fractional
    (2, 4, 1, D(2019, 4, 1), 1.0, 20, 1),
    (2, 5, 1, D(2019, 4, 1), 60.0, 21, 1),  # zone price rule, outlier
    (2, 5, 1, None, None, 21, 1),
]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def dims(spark):
    sites = spark.createDataFrame([(4, 1), (5, 1)], "site_id bigint, site_zone_id bigint")
    articles = spark.createDataFrame([(1,), (2,)], "article_id bigint")
    return sites, articles


KEYS = ["article_id", "site_id", "zone_id", "day"]


def test_every_member_of_a_duplicate_is_returned(sales):
    got = sorted(r.quantity for r in Q.duplicates(sales, KEYS).collect())
    assert got == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_null_keys_are_duplicates_of_each_other(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k int, v int")
    assert sorted(r.v for r in Q.duplicates(df, ["k"]).collect()) == [1, 2]


def test_later_copies(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 9), (None, 5), (None, 4)], "k int, o int")
    assert sorted((r.k is None, r.o) for r in Q.later_copies(df, ["k"], ["o"]).collect()) == [(False, 2), (False, 3), (True, 5)]


def test_null_is_no_second_value(sales):
    got = Q.conflicting_keys(sales, KEYS, "price").collect()
    assert [(r.article_id, r.site_id, r.n_values) for r in got] == [(1, 4, 2)]
    assert Q.conflicting_rows(sales, KEYS, "price").count() == 3


def test_null_keys_form_no_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "k int, v int")
    assert Q.conflicting_keys(df, ["k"], "v").count() == 0 and Q.conflicting_rows(df, ["k"], "v").count() == 0


def test_report(sales, dims):
    got = {r["check"]: (r.violations, r.first_day, r.last_day) for r in audit_report(sales, *dims).collect()}
    assert got == {
        "orphan_site": (1, D(2019, 2, 1), D(2019, 2, 1)),
        "unknown_article": (1, D(2019, 3, 1), D(2019, 3, 1)),
        "zone_mismatch": (2, D(2019, 2, 1), D(2019, 2, 2)),
        "missing_cost": (1, D(2019, 1, 2), D(2019, 1, 2)),
        "missing_price": (1, D(2019, 1, 2), D(2019, 1, 2)),
        "negative_margin": (1, D(2019, 2, 2), D(2019, 2, 2)),
        "non_positive_quantity": (2, D(2019, 2, 1), D(2019, 2, 2)),
        "fractional_quantity": (2, D(2019, 3, 1), D(2019, 3, 1)),
        "quantity_above_cutoff": (1, D(2019, 4, 1), D(2019, 4, 1)),
        "duplicate_key": (5, D(2019, 1, 1), D(2019, 1, 2)),
        "cost_conflict": (0, None, None),
        "price_conflict": (1, D(2019, 1, 1), D(2019, 1, 1)),
        "zone_price_rule": (2, D(2019, 1, 1), D(2019, 4, 1)),
    }


def test_fused_report_equals_separate_checks(sales, dims):
    rows = groups = {r["check"]: r.violations for r in audit_report(sales, *dims).collect()}
    assert rows["negative_margin"] == sales.where("price - cost_price < 0").count()
    assert rows["zone_mismatch"] == Q.zone_mismatches(sales, dims[0]).count()
    assert rows["orphan_site"] == Q.orphan_sites(sales, dims[0]).count()
    assert rows["fractional_quantity"] == Q.fractional_rows(sales, "quantity").count()
    assert groups["duplicate_key"] == Q.duplicates(sales, KEYS).count()
    assert groups["price_conflict"] == Q.conflicting_keys(sales, KEYS, "price").count()
    assert groups["zone_price_rule"] == Q.conflicting_keys(sales, ["article_id", "day", "zone_id"], "price").count()


def test_empty_table_gives_a_report(sales, dims):
    got = audit_report(sales.where("false"), *dims)
    assert got.count() == 13 and got.where("violations <> 0").count() == 0


def test_fences_and_outliers(sales):
    values = [r[4] for r in ROWS if r[4] is not None]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    f = Q.tukey_fences(sales, "quantity").first()
    assert (f.q1, f.q3, f.upper) == (q1, q3, q3 + 1.5 * (q3 - q1))
    assert sorted(r.quantity for r in Q.outliers(sales, "quantity").collect()) == sorted(
        v for v in values if v < f.lower or v > f.upper
    )
    assert [r.quantity for r in Q.outliers(sales, "quantity", cutoff=50).collect()] == [60.0]


def test_finding_and_period(sales):
    f = Q.finding(sales, F.col("quantity") <= 0, "day").first()
    assert (f.violations, f.pct, f.first_day) == (2, 2 * 100.0 / 11, D(2019, 2, 1))
    p = Q.period(sales.where("quantity <= 0"), "day").first()
    assert (p.violations, p.days) == (2, 1)


def test_nulls_by_period(sales):
    got = Q.nulls_by_period(sales.where("day is not null"), "price", 0.1, "day").collect()
    assert [(r.period, r.nulls, r.rows) for r in got] == [(D(2019, 1, 1), 1, 5)]


def test_returns_are_flagged(sales):
    got = {(r.quantity, r.kind) for r in Q.flag_returns(sales, "quantity").collect()}
    assert {(-1.0, "return"), (0.0, "empty"), (60.0, "sale"), (None, None)} <= got


def test_missing_price_takes_the_mean_of_the_next_days(spark):
    rows = [
        (1, D(2019, 1, 1), None),
        (1, D(2019, 1, 1), 99),  # same day does not count
        (1, D(2019, 1, 2), 10),
        (1, D(2019, 3, 2), 20),  # day 60
        (1, D(2019, 3, 3), 1000),  # day 61
        (1, D(2019, 3, 3), None),  # nothing ahead
        (2, D(2019, 1, 1), None),
    ]
    df = spark.createDataFrame(rows, "k int, day date, price bigint")
    got = Q.repair_price(df, ["k"], "day", "price").where("price is null").collect()
    assert {(r.k, r.day): r.repaired for r in got} == {
        (1, D(2019, 1, 1)): 15.0,
        (1, D(2019, 3, 3)): None,
        (2, D(2019, 1, 1)): None,
    }


def test_text_format(spark):
    df = spark.createDataFrame([("a b", 'x"y'), ("ab", "z"), (None, None)], "k string, n string")
    got = {r.column: (r.with_space, r.with_quote) for r in Q.text_format(df, ["k", "n"]).collect()}
    assert got == {"k": (1, 0), "n": (0, 1)}


SALE = "article_id bigint, site_id bigint, zone_id bigint, day date, quantity double, price double, cost_price double"


def test_nan_counts_as_missing(spark):
    day, nan = D(2020, 1, 1), float("nan")
    rows = [(1, 1, 1, day, 1.0, nan, 5.0), (1, 1, 1, day, 1.0, 10.0, nan)]
    dims = spark.createDataFrame([(1, 1)], "site_id bigint, site_zone_id bigint"), spark.createDataFrame([(1,)], "article_id bigint")
    empty = [tuple(None if v != v else v for v in r) for r in rows]
    got, want = (
        {r["check"]: r.violations for r in audit_report(spark.createDataFrame(x, SALE), *dims).collect()} for x in (rows, empty)
    )
    assert got == want
    assert (got["missing_price"], got["missing_cost"], got["price_conflict"], got["zone_price_rule"]) == (1, 1, 0, 0)


def test_repeated_dimension_rows_are_an_error(spark):
    sale = spark.createDataFrame([(1, 7, 1, D(2020, 1, 1), 1.0, 1.0, 1.0)], SALE)
    sites = spark.createDataFrame([(7, 1), (7, 1)], "site_id bigint, site_zone_id bigint")
    articles = spark.createDataFrame([(1,)], "article_id bigint")
    with pytest.raises(Exception, match="repeated lookup key 7"):
        audit_report(sale, sites, articles).collect()
    with pytest.raises(Exception, match="repeated lookup key 1"):
        audit_report(sale, sites.distinct(), articles.union(articles)).collect()


def test_repair_reads_the_table_twice(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), None), (1, D(2020, 1, 1), 3.0), (1, D(2020, 1, 5), 8.0)], "k int, day date, price double")
    got = Q.repair_price(df, ["k"], "day", "price").collect()
    assert sorted((str(r.price), r.repaired) for r in got) == [("3.0", 3.0), ("8.0", 8.0), ("None", 8.0)]
