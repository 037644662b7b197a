import datetime as dt
import json

from pyspark.sql import functions as F

from tallyfield.sources import files, orders


def test_csv_with_mark_blank_lines_and_inner_quotes(spark, tmp_path):
    path = tmp_path / "articles.csv"
    path.write_bytes('﻿ArticleId,ArticleName\n1,plain\n2,"FRIES "B" 1KG"\n\n\n'.encode())
    df = files.read_csv(spark, str(path), "ArticleId bigint, ArticleName string")
    rows = [tuple(r) for r in df.collect()]
    assert [r[0] for r in rows] == [1, 2] and rows[0][1] == "plain" and '"B"' in rows[1][1]
    inferred = files.read_csv(spark, str(path))
    assert inferred.columns == ["ArticleId", "ArticleName"] and inferred.count() == 2


def test_csv_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "i bigint, t string, x double")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_orders_as_object_and_as_array(spark, tmp_path):
    one = {"id": 1, "orderTime": "2023-05-02T00:30:00.000+01:00", "items": [{"id": 7, "name": "milk", "amount": 2}]}
    many = [
        {"id": 2, "orderTime": "bad", "items": [{"id": 8, "name": "tea", "amount": 1}, {"id": 9, "name": "jam", "amount": 3}]},
        {"id": 3, "orderTime": "2023-05-02T10:00:00.000Z"},
        {"id": 4, "orderTime": "2023-05-02T10:00:00.000Z", "items": []},
    ]
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps(many))
    flat = orders.flatten_orders(orders.read_orders(spark, str(tmp_path), documents=True))
    assert flat.columns == ["order_id", "date", "order_orderTime", "id", "name", "amount"]
    assert sorted(tuple(r) for r in flat.collect()) == [
        (1, dt.date(2023, 5, 1), one["orderTime"], 7, "milk", 2),
        (2, None, "bad", 8, "tea", 1),
        (2, None, "bad", 9, "jam", 3),
    ]


def test_missing_order_columns_are_null(spark):
    df = spark.createDataFrame([(1, [(5,)])], "id bigint, items array<struct<id:bigint>>")
    assert [tuple(r) for r in orders.flatten_orders(df).collect()] == [(1, None, None, 5, None, None)]


def test_json_dimension_append(spark, tmp_path):
    schema = "id bigint, mainCategoryId bigint, name string, status string"
    old = spark.createDataFrame([(1, 10, "a", "ok"), (2, None, None, "error")], schema)
    new = spark.createDataFrame([(2, 20, "b", "ok"), (3, None, None, "not_found")], schema)
    files.write_json(old, str(tmp_path / "old"))
    out = files.append_json(spark, str(tmp_path / "old"), new, "id", str(tmp_path / "new"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 10, "a", "ok"), (2, 20, "b", "ok"), (3, None, None, "not_found")]


def test_text_report_keeps_the_order(spark, tmp_path):
    df = spark.range(200).select((F.lit(199) - F.col("id")).alias("at")).withColumn("line", F.format_string("%03d", "at"))
    files.write_lines(df, str(tmp_path / "report"), "line", ["at"])
    parts = sorted((tmp_path / "report").glob("part-*"))
    lines = [x for p in parts for x in p.read_text().split()]
    assert lines == [f"{i:03d}" for i in range(200)]


def test_partitioned_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, k string")
    files.write_table(df, str(tmp_path / "t.parquet"), ["k"])
    back = files.read_table(spark, str(tmp_path), "t")
    assert sorted(tuple(r) for r in back.select("v", "k").collect()) == [(1, "x"), (2, "y")]
