import datetime as dt

from pyspark.sql import functions as F

from tallyfield.plans.audit import REPORT, audit_report, summarise
from tallyfield.streaming.audits import audit_stream, combine, drain

SCHEMA = "article_id bigint, site_id bigint, zone_id bigint, day date, quantity double, price bigint, cost_price bigint"


def batches(spark, folder):
    for b in range(3):
        rows = [
            (i % 4, i % 6, i % 2, dt.date(2023, 1 + b, 1 + i % 9), float(i % 5 - 1), None if i % 7 == 0 else 10 + i, 12)
            for i in range(40)
        ]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_batches_add_up_to_the_whole(spark, tmp_path):
    folder = str(tmp_path / "sales")
    batches(spark, folder)
    sites = spark.createDataFrame([(i, i % 2) for i in range(5)], "site_id bigint, site_zone_id bigint")
    articles = spark.range(4).select(F.col("id").alias("article_id"))

    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    filed = drain(spark, arriving, summarise)
    assert {r.batch for r in filed.select("batch").distinct().collect()} == {0, 1, 2}
    whole = {tuple(r) for r in audit_report(spark.read.parquet(folder), sites, articles).collect()}
    assert {tuple(r) for r in combine(filed, sites, articles).collect()} == whole
    assert len(whole) == 13


def test_repeats_and_conflicts_between_batches_count(spark, tmp_path):
    folder, day = str(tmp_path / "sales"), dt.date(2023, 1, 1)
    for price in (10, 11, 12):
        rows = [(1, 1, 1, day, 1.0, price, 5)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    sites = spark.createDataFrame([(1, 1)], "site_id bigint, site_zone_id bigint")
    articles = spark.createDataFrame([(1,)], "article_id bigint")
    got = {r["check"]: (r.violations, r.pct) for r in combine(drain(spark, arriving, summarise), sites, articles).collect()}
    assert got["duplicate_key"] == (3, 100.0)
    assert got["price_conflict"][0] == got["zone_price_rule"][0] == 1 and got["cost_conflict"][0] == 0
    assert len(REPORT) == 6


def test_a_second_run_audits_only_what_is_new(spark, tmp_path):
    folder, reports, progress = (str(tmp_path / n) for n in ("sales", "reports", "progress"))

    def audit(df):
        return df.agg(
            F.lit("rows").alias("check"), F.lit("rows").alias("scope"), F.count(F.lit(1)).alias("violations"),
            F.lit(100.0).alias("pct"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        )

    for _ in range(2):
        batches(spark, folder)
        arriving = spark.readStream.schema(SCHEMA).parquet(folder)
        audit_stream(arriving, audit, reports, progress).awaitTermination()
    got = spark.read.parquet(reports)
    assert sorted((r.batch, r.violations) for r in got.collect()) == [(0, 120), (1, 120)]


def test_a_batch_is_made_of_bounded_files(spark, monkeypatch):
    from tallyfield.bindings import modelled

    folder, seen = "/root/testdata/sf0.001", []
    size = modelled.bytes_below(spark, f"{folder}/lineitem.parquet")
    monkeypatch.setattr(modelled, "FILE_BYTES", -(-size // 12))
    arriving = modelled.arriving_lines(spark, folder, 4)
    arriving = arriving.withColumn("file", F.input_file_name())
    count = lambda batch, _: seen.append((batch.count(), batch.select("file").distinct().count()))
    running = arriving.writeStream.foreachBatch(count).option("checkpointLocation", modelled.scratch_path(spark, "counted")).trigger(availableNow=True)
    running.start().awaitTermination()
    assert [files for _, files in seen] == [3] * 4
    assert sum(rows for rows, _ in seen) == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_a_file_that_arrives_is_what_a_task_reads(spark, tmp_path):
    from tallyfield.bindings import modelled, tables
    from tallyfield.session import READ_BYTES

    schema = spark.createDataFrame([], tables.SCHEMAS["lineitem"]).schema
    values = {"l_extendedprice": F.rand(1), "l_discount": F.rand(2), "l_tax": F.rand(3), "l_orderkey": F.col("id")}
    rows = spark.range(250_000).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    size = modelled.bytes_below(spark, str(tmp_path / "lineitem.parquet"))
    seen = []
    arriving = modelled.arriving_lines(spark, str(tmp_path), 1).withColumn("file", F.input_file_name())
    count = lambda batch, _: seen.append((batch.count(), batch.select("file").distinct().count()))
    running = arriving.writeStream.foreachBatch(count).option("checkpointLocation", modelled.scratch_path(spark, "counted")).trigger(availableNow=True)
    running.start().awaitTermination()
    assert seen == [(250_000, -(-size // READ_BYTES))] and 1 < seen[0][1] and READ_BYTES <= 4 << 20
