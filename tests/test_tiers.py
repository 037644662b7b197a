import datetime as dt

from pyspark.sql import functions as F

from tallyfield.plans.audit import audit_report, merge, report, summarise
from tallyfield.streaming.tiers import Tiers, cover, tiered_stream

from test_stream import SCHEMA


def totals(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def batch(spark, number):
    return spark.createDataFrame([(number % 3, 10**number if number < 15 else number), (9, 1)], "k int, n long").coalesce(1)


def test_a_cover_holds_every_batch_once_and_is_short():
    for fan in (2, 3, 8):
        for n in [*range(70), 1000]:
            spans = [(k * fan**t, (k + 1) * fan**t) for t, k in cover(n, fan)]
            assert [b for a, b in spans] == [a for a, b in spans][1:] + [n] * bool(n) and (not n or spans[0][0] == 0)
    assert len(cover(1000, 8)) == 1 + 7 + 5 and len(cover(1_000_000, 8)) <= 7 * 7


def test_tiers_hold_all_batches_and_little_else(spark, tmp_path):
    tiers = Tiers(spark, str(tmp_path / "t"), totals, fan=3)
    whole = None
    for number in range(20):
        tiers.file(batch(spark, number), number)
        whole = batch(spark, number) if whole is None else whole.union(batch(spark, number))
        if number in (0, 2, 8, 13, 19):
            assert tiers.live() == cover(number + 1, 3)
            assert sorted(totals(tiers.read()).collect()) == sorted(totals(whole).collect())
    # besides what counts, only what the last batch's merges took over is still there
    assert len(tiers.complete()) <= len(cover(20, 3)) + 6


def test_a_replayed_batch_replaces_its_share(spark, tmp_path):
    tiers = Tiers(spark, str(tmp_path / "t"), totals, fan=2)
    for number in range(4):
        tiers.file(batch(spark, number + 20), number)
    before = sorted(totals(tiers.read()).collect())
    tiers.file(batch(spark, 50), 3)  # another try with other rows
    changed = sorted(totals(tiers.read()).collect())
    assert changed != before and tiers.live() == [(2, 0)]
    want = batch(spark, 20).union(batch(spark, 21)).union(batch(spark, 22)).union(batch(spark, 50))
    assert changed == sorted(totals(want).collect())
    tiers.file(batch(spark, 23), 3)
    assert sorted(totals(tiers.read()).collect()) == before


def test_a_merge_that_broke_off_does_not_count(spark, tmp_path):
    tiers = Tiers(spark, str(tmp_path / "t"), totals, fan=2)
    for number in range(2):
        tiers.file(batch(spark, number), number)
    (tmp_path / "t" / "tier=1" / "number=0" / "_SUCCESS").unlink()
    assert tiers.live() == [(0, 0), (0, 1)]
    tiers.file(batch(spark, 2), 2)
    assert sorted(totals(tiers.read()).collect()) == sorted(totals(batch(spark, 0).union(batch(spark, 1)).union(batch(spark, 2))).collect())
    assert Tiers(spark, str(tmp_path / "none"), totals).live() == []


def test_the_audit_over_tiers_equals_the_batch_report(spark, tmp_path):
    folder = str(tmp_path / "sales")
    for b in range(5):
        rows = [(i % 4, i % 6, i % 2, dt.date(2023, 1 + b % 2, 1 + i % 9), float(i % 5 - 1), None if i % 7 == 0 else 10 + i + b, 12) for i in range(40)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    sites = spark.createDataFrame([(i, i % 2) for i in range(5)], "site_id bigint, site_zone_id bigint")
    articles = spark.range(4).select(F.col("id").alias("article_id"))
    tiers = Tiers(spark, str(tmp_path / "filed"), merge, fan=2)
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    tiered_stream(arriving, summarise, tiers, str(tmp_path / "progress")).awaitTermination()
    assert tiers.live() == [(2, 0), (0, 4)]
    got = {tuple(r) for r in report(merge(tiers.read()), sites, articles).collect()}
    assert got == {tuple(r) for r in audit_report(spark.read.parquet(folder), sites, articles).collect()}
