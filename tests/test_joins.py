import pytest
from pyspark.sql import functions as F

from tallyfield.operators import joins as J


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lookup_keeps_unmatched_rows(spark):
    s = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "id int, site int")
    d = spark.createDataFrame([(5, "north")], "site int, name string")
    assert rows(J.lookup(s, d, "site", "site", {"site_name": "name"})) == [(1, 5, "north"), (2, 9, None), (3, None, None)]


def test_scalar_lookup_refuses_repeated_keys(spark):
    s = spark.createDataFrame([(1,)], "k int")
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated lookup key"):
        J.map_values(s, d, "k", "k", "v", "out").collect()


def test_anti_join_ignores_nulls_in_the_list(spark):
    s = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    d = spark.createDataFrame([(1,), (None,)], "k int")
    assert rows(J.orphans(s, d, "k", "k")) == [(2,), (None,)]


def test_unknown_key_is_a_mismatch(spark):
    s = spark.createDataFrame([(4, 1), (5, 2), (9, 1)], "site int, zone int")
    d = spark.createDataFrame([(4, 1), (5, 1)], "site int, zone int")
    assert rows(J.attribute_mismatch(s, d, "site", "site", "zone", "zone")) == [(5, 2, 1), (9, 1, None)]


def test_status_set_drops_rows(spark):
    s = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    d = spark.createDataFrame([(1, "ok"), (2, "error")], "id int, status string")
    assert rows(J.drop_keys(s, d, "id", "id", F.col("status") == "error")) == [(1,), (3,)]


def test_rows_with_null_keys_meet(spark):
    s = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    assert rows(J.rows_with_keys(s, s.where("k is null"), ["k"])) == [(None, 1)]


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(3,)], "a int")
    assert rows(J.union_all(a, b)) == [(1, 2), (3, None)]


def test_key_difference_and_new_keys(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,)], "k int")
    assert rows(J.key_difference(a, b, ["k"])) == [(2,), (None,)]
    assert rows(J.new_keys(a, b, "k", "k")) == [(2,)]


def test_first_and_upsert(spark):
    a = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (2, 1, None)], "k int, o int, v string")
    assert rows(J.first_per_key(a, ["k"], ["o"])) == [(1, 1, "y"), (2, 1, None)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(J.upsert(old, new, ["k"])) == [(1, "a"), (2, None), (3, "c")]


def test_align_fills_zeros_only_where_asked(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 5, 6)], "k int, x int, y int")
    assert rows(J.align(a, b, ["k"], ["x"])) == [(1, 5, 6), (2, 0, None)]
