import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import ordering
from tallyfield.operators.ordering import number_rows, quantiles, running_totals


def skewed(rng, rows=3000):
    """A third of the rows belong to one group; one group key is null."""
    groups = rng.integers(0, 40, rows)
    groups[: rows // 3] = 7
    return [(None if g == 3 else int(g), int(v), i) for i, (g, v) in enumerate(zip(groups, rng.integers(0, 50, rows)))]


def test_numbering_equals_sorting_each_group(spark):
    rows = skewed(np.random.default_rng(1))
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(5)
    got = {r.i: (r.seq, r.n) for r in number_rows(df, ["g"], ["v", "i"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        members = sorted((v, i) for gg, v, i in rows if gg == g)
        for place, (_, i) in enumerate(members, 1):
            want[i] = (place, len(members))
    assert got == want


def test_numbering_over_the_whole_table_descending(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("k"))
    got = number_rows(df, [], [F.desc("k"), F.col("id")], "place", None).orderBy("place").collect()
    want = sorted(((-(i % 10), i) for i in range(1000)))
    assert [r.id for r in got] == [i for _, i in want] and [r.place for r in got] == list(range(1, 1001))


def test_a_hot_group_is_split_over_slices(spark, monkeypatch):
    from tallyfield.operators.ordering import SLICE, range_slices

    monkeypatch.setattr(ordering, "SLICE_BYTES", 4000)
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("g"), "id")
    per = range_slices(df, ["g"], ["id"]).where("g = 1").groupBy(SLICE).count().collect()
    assert len(per) >= 2


def test_running_totals(spark):
    rows = skewed(np.random.default_rng(2), 900)
    df = spark.createDataFrame(rows, "g int, v int, i int")
    got = {r.i: (r.before, r.total) for r in running_totals(df, ["g"], ["v", "i"], "v").collect()}
    for g in {r[0] for r in rows}:
        members = sorted((v, i) for gg, v, i in rows if gg == g)
        total, before = sum(v for v, _ in members), 0
        for v, i in members:
            assert got[i] == (before, total)
            before += v


PROBS = {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "hi": 1.0}


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "heavy"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    n = 60_000
    values = {
        "spread": rng.normal(size=n) * 1e3,
        "ties": rng.integers(0, 12, n).astype(float),
        "few": rng.normal(size=3),
        "heavy": np.where(rng.random(n) < 0.5, 4.0, rng.normal(size=n)),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = quantiles(df, "v", PROBS).first()
    for name, p in PROBS.items():
        assert math.isclose(got[name], float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_grouped_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(4)
    n = 120_000
    groups = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 500, n))
    values = rng.normal(size=n)
    rows = [(int(g), float(v)) for g, v in zip(groups, values)] + [(5, None), (9999, None), (6, math.nan)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.q1, r.q2) for r in quantiles(df, "v", {"q1": 0.25, "q2": 0.5}, ["g"]).collect()}
    assert set(got) == set(int(g) for g in groups) | {9999} and got.pop(9999) == (None, None)
    for g in got:
        assert np.allclose(got[g], np.quantile(values[groups == g], [0.25, 0.5]), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 5_000, 5_001, 9_999, 10_001, 200_000])
def test_quantiles_of_every_size(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    probs = {**PROBS, "p01": 0.01, "p37": 0.37, "p999": 0.999}
    got = quantiles(spark.createDataFrame(pd.DataFrame({"v": values})).repartition(7), "v", probs).first()
    assert np.allclose([got[k] for k in probs], np.quantile(values, list(probs.values())), rtol=1e-12)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_a_missed_rank_is_looked_for_again(spark, monkeypatch, by):
    """Brackets that hold no wanted rank: the exact counts lead to wider ones."""
    from tallyfield.operators import ordering

    values = np.random.default_rng(1).normal(size=3_000)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": values}))

    def wrong(rows, probs, by, also):
        return rows.groupBy(*by).agg(F.array(*[F.lit(9.0)] * (2 * len(probs))).alias("_ends"), *also)

    monkeypatch.setattr(ordering, "_brackets", wrong)
    got = quantiles(df, "v", PROBS, by, {"mean": F.avg}).first()
    assert np.allclose([got[k] for k in PROBS], np.quantile(values, list(PROBS.values())), rtol=1e-12)
    assert math.isclose(got["mean"], values.mean())


@pytest.mark.parametrize("sketch", [10_000, 50, 3])
def test_quantiles_of_several_columns(spark, monkeypatch, sketch):
    """Whatever the sketch is worth: a rank that its brackets miss is looked for again."""
    monkeypatch.setattr(ordering, "SKETCH", sketch)
    rng = np.random.default_rng(8)
    n = 3000
    frame = pd.DataFrame(
        {"even": rng.random(n), "few": rng.integers(0, 4, n).astype(float), "same": np.full(n, 7.0), "odd name": rng.exponential(size=n), "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)), "none": np.full(n, np.nan)}
    )
    df = spark.createDataFrame(frame).repartition(5)
    probs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "top": 1.0}
    got = {r["column"]: r for r in ordering.column_quantiles(df, list(frame), probs, {"n": F.count, "low": F.min}).collect()}
    assert set(got) == set(frame)
    for c in frame:
        own = frame[c].dropna()
        assert got[c].n == len(own) and got[c].low == (None if own.empty else own.min())
        for name, p in probs.items():
            assert got[c][name] == (None if own.empty else pytest.approx(own.quantile(p), rel=1e-12))
    assert [r.n for r in ordering.column_quantiles(df.limit(0), ["even"], probs, {"n": F.count}).collect()] == [0]


def test_values_outside_the_brackets_never_become_rows(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("a"), (F.col("id") % 1000).cast("double").alias("b"))
    ends = [[50_000.0, 50_100.0, 100_000.0, 100_100.0], [249.0, 251.0, 499.0, 501.0]]
    counts = ordering._column_counts(df.toDF("_v0", "_v1"), ends, ["a", "b"])
    rows = counts.collect()
    assert sum(r["_c"] for r in rows) == 400_000 and len(rows) < 230


@pytest.mark.parametrize("size", [64 << 20, 20_000, 400])
def test_results_do_not_depend_on_the_number_of_slices(spark, monkeypatch, size):
    monkeypatch.setattr(ordering, "SLICE_BYTES", size)
    rows = skewed(np.random.default_rng(3), 2000)
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(5)
    got = {r.i: (r.seq, r.n) for r in number_rows(df, ["g"], ["v", "i"]).collect()}
    sums = {r.i: (r.before, r.total) for r in running_totals(df, ["g"], ["v", "i"], "v").collect()}
    for g in {r[0] for r in rows}:
        before, members = 0, sorted((v, i) for gg, v, i in rows if gg == g)
        total = sum(v for v, _ in members)
        for place, (v, i) in enumerate(members, 1):
            assert got[i] == (place, len(members)) and sums[i] == (before, total)
            before += v


def test_no_slice_holds_more_than_its_share_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_BYTES", 2000)
    same = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(5).alias("v"))
    monkeypatch.setattr(ordering, "written", lambda df, label: (real(df, label)[0], 80_000))
    laid = ordering.range_slices(same, ["k"], ["v"])
    sizes = [r["count"] for r in laid.groupBy(ordering.SLICE).count().collect()]
    assert len(sizes) >= 30 and max(sizes) < 4 * 20_000 / 40
    numbered = number_rows(same, ["k"], ["v"])
    assert numbered.agg(F.count_distinct("seq"), F.max("seq"), F.max("n")).first()[:] == (20_000, 20_000, 20_000)


def test_slices_follow_the_bytes(spark):
    assert ordering.slice_count(spark, 0) == 1 and ordering.slice_count(spark, 1 << 18) == 1
    assert ordering.slice_count(spark, 1 << 40) == (1 << 40) // (64 << 20)
    assert ordering.slice_count(spark, 50 << 20) == spark.sparkContext.defaultParallelism


real = ordering.written
