import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import scalars as S


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, "b"), (None, "c")], "x double, t string")
    assert [r.x for r in S.nan_to_null(df).collect()] == [1.0, None, None]


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert S.select_present(df, ["b", "zz", "a"]).columns == ["b", "a"]


def test_bad_days_become_null(spark):
    rows = [("2019-02-28",), ("2019-02-30",), ("junk",), (None,)]
    got = values(spark, rows, "t string", S.parse_day("t"), S.is_unparsed_day("t"))
    assert got == [(dt.date(2019, 2, 28), False), (None, True), (None, True), (None, False)]


@pytest.mark.parametrize(
    "text, day",
    [
        ("2023-05-01T23:30:00.000+0100", dt.date(2023, 5, 1)),
        ("2023-05-02T00:30:00.123456+01:00", dt.date(2023, 5, 1)),
        ("2023-05-01T23:30:00.5-0300", dt.date(2023, 5, 2)),
        ("2023-05-01T12:00:00.000Z", dt.date(2023, 5, 1)),
        ("2023-05-01T12:00:00+0100", None),  # no fraction
        ("2023-05-01T12:00:00.000", None),  # no offset
        ("garbage", None),
        (None, None),
    ],
)
def test_order_day_is_the_utc_day(spark, text, day):
    assert values(spark, [(text,)], "t string", S.order_day("t")) == [(day,)]


def test_order_day_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = values(spark, [("2023-05-02T00:30:00.0+01:00",)], "t string", S.order_day("t"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(dt.date(2023, 5, 1),)]


def test_fractional_covers_null_and_nan(spark):
    rows = [(1.0,), (1.5,), (-2.0,), (math.nan,), (None,)]
    assert [r[0] for r in values(spark, rows, "x double", S.is_fractional("x"))] == [False, True, False, True, True]


def test_text_helpers(spark):
    rows = [("C85", "Heron, Mlle. Ida"), ("", "Heron, Dona. Ida"), (None, "Heron, Mrs. Ida"), ("G6 F2", "no title")]
    got = values(spark, rows, "c string, n string", S.first_letter("c"), S.title_class("n"), S.has_space("c"))
    assert got == [("C", "Miss", False), ("U", "Rare", False), ("U", "Mrs", None), ("G", None, True)]


def test_every_listed_title_is_recoded(spark):
    rows = [(f"X, {t}. Y",) for t in S.RARE_TITLES + S.MISS_TITLES + ["Mr", "Master"]]
    got = [r[0] for r in values(spark, rows, "n string", S.title_class("n"))]
    assert got == ["Rare"] * 11 + ["Miss"] * 3 + ["Mr", "Master"]


def test_numbers(spark):
    rows = [(29.0, 2, 1), (None, 0, 0), (15.0, 1, None)]
    got = values(spark, rows, "a double, s int, p int", S.floor_to("a", 15), S.family_size("s", "p"), S.whole("a"))
    assert got == [(15.0, 4, 29), (None, 1, 0), (15.0, None, 15)]


def test_calendar_parts(spark):
    got = values(spark, [(dt.date(2023, 5, 1),), (dt.date(2023, 5, 7),)], "d date", S.month_of("d"), S.weekday_of("d"))
    assert got == [(5, 0), (5, 6)]


def test_missing_side_counts_as_different(spark):
    rows = [(1, 1), (1, 2), (1, None), (None, None)]
    assert [r[0] for r in values(spark, rows, "a int, b int", S.zone_differs("a", "b"))] == [False, True, True, True]


def test_display_text(spark):
    rows = [(0.456, "milk", 7, None, None), (0.5, "tea", None, "", 3)]
    line = S.suggestion_line("p", S.product_label("a", "i"), S.product_label("b", "j"))
    got = values(spark, rows, "p double, a string, i bigint, b string, j bigint", line)
    assert got == [(" 0.46  milk [7]",), (" 0.50  tea",)]


def test_scaled_rounds_half_up(spark):
    assert values(spark, [(1.2345675,)], "x double", S.scaled(F.col("x"), 3), S.percent(F.lit(253), F.lit(17997))) == [
        (1235, 253 * 100.0 / 17997)
    ]
