import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import imputation as I
from tallyfield.operators import profiles as P


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("f", 1, 30.0, 1, "S", "t1"),
        ("f", 1, None, 1, None, "t1"),
        ("f", 3, 20.0, 0, "Q", "t2"),
        ("m", 3, 40.0, 0, "S", None),
        ("m", 3, 22.0, 1, "S", "t2"),
        ("m", 3, None, 0, "C", "t2"),
        ("m", 2, None, 0, None, "t3"),
    ]
    return spark.createDataFrame(rows, "sex string, klass int, age double, label int, port string, ticket string")


def pdf(people):
    return people.toPandas()


def test_describe_equals_pandas(people):
    want = pdf(people)[["age", "klass"]].describe()
    for r in P.describe(people, ["age", "klass"]).collect():
        got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert np.allclose(got, want[r.column].values)


def test_shares_equal_pandas_crosstab(people):
    frame = pdf(people)
    for over in ("index", "columns"):
        want = pd.crosstab([frame["sex"], frame["port"]], frame["label"], normalize=over)
        long = {(r.sex, r.port, r.label): r.share for r in P.crosstab_share(people, ["sex", "port"], "label", over).collect()}
        wide = P.crosstab_wide(people, ["sex", "port"], "label", [0, 1], over).collect()
        for (sex, port), line in want.iterrows():
            for label in (0, 1):
                assert np.isclose(long.get((sex, port, label), 0.0), line[label])
        assert len(wide) == len(want)
        for r in wide:
            assert np.allclose([r.share_0, r.share_1], want.loc[(r.sex, r.port)].values)


def test_group_reports(people):
    rate = {r.sex: r.rate for r in P.label_rate(people, ["sex"], "label").collect()}
    assert rate == pytest.approx({"f": 2 / 3, "m": 0.25})
    counts = {r.sex: (r.positive, r.negative) for r in P.outcome_counts(people, ["sex"], "label").collect()}
    assert counts == {"f": (2, 1), "m": (1, 3)}
    center = {(r.sex, r.klass): (r["median"], r["mean"]) for r in P.group_center(people, ["sex", "klass"], "age").collect()}
    assert center[("m", 3)] == (31.0, 31.0) and center[("m", 2)] == (None, None)
    assert [(r.port, r["count"]) for r in P.value_counts(people, "port").collect()][0] == ("S", 3)


def test_null_profile_and_drift(people, spark):
    got = {r.column: (r.type, r.non_null, r.nulls) for r in P.null_profile(people).collect()}
    assert got["age"] == ("double", 4, 3) and got["sex"] == ("string", 7, 0)
    other = people.drop("label").withColumn("extra", F.lit(1)).where("sex = 'f'")
    drift = {r.column: (r.side, r.left_null_share, r.right_null_share) for r in P.profile_drift(people, other).collect()}
    assert drift["label"] == ("left", 0.0, None) and drift["extra"] == ("right", None, 0.0)
    assert drift["age"] == pytest.approx(("both", 3 / 7, 1 / 3))


def test_type_audit(spark):
    df = spark.createDataFrame(
        [(1.0, 1.5, "2020-01-01", "x"), (2.0, 2.0, "2020-02-01", "2020-01-01"), (None, None, None, None)],
        "a double, b double, d string, t string",
    )
    assert {r.column: r.flagged for r in P.type_audit(df).collect()} == {"a": True, "b": False, "d": True, "t": False}


@pytest.mark.parametrize("kind", ["normal", "integers", "constant"])
def test_histogram_equals_numpy(spark, kind):
    rng = np.random.default_rng(5)
    values = {"normal": rng.normal(size=500), "integers": rng.integers(0, 31, 500).astype(float), "constant": np.full(5, 3.0)}[kind]
    want, edges = np.histogram(values, bins=30)
    got = P.histogram(spark.createDataFrame(pd.DataFrame({"v": values})), "v", 30).orderBy("bin").collect()
    assert [r["count"] for r in got] == list(want)
    assert np.allclose([r.lower for r in got], edges[:-1])


def test_histogram_per_group_uses_own_range(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 5.0), ("b", 6.0), (None, 1.0)], "g string, v double")
    got = {(r.g, r.bin): r["count"] for r in P.histogram(df, "v", 2, ["g"]).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("b", 0): 1, ("b", 1): 1}


def test_mode_takes_the_smallest_on_ties(people):
    assert P.most_frequent(people.where("port <> 'S'"), "port").first()[0] == "C"
    assert {r.sex: r.port for r in P.most_frequent(people, "port", ["sex"]).collect()} == {"f": "Q", "m": "S"}


def test_peak_days_keep_ties(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 1.0), (3, 1.0), (None, 9.0)], "day int, q double")
    assert sorted(r.day for r in P.peak_days(P.daily_totals(df, "day", "q")).collect()) == [1, 2]


def test_group_median_fill(people):
    got = {(r.sex, r.klass, r.ticket): r.age for r in I.fill_group_median(people, ["sex", "klass"], "age").collect() if r.port != "S"}
    assert got[("f", 1, "t1")] == 30.0 and got[("m", 3, "t2")] == 31.0 and got[("m", 2, "t3")] is None


def test_group_size_of_a_null_key_is_null(people):
    got = {r.ticket: r.group_size for r in I.group_size(people, "ticket").collect()}
    assert got == {"t1": 2, "t2": 3, "t3": 1, None: None}


def test_scaling_is_population_and_constant_safe(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "x double, k double")
    out = I.scale(train, I.scaling_table(train, ["x", "k"]), ["x", "k"]).collect()
    assert np.isclose(out[0].x, -1.3416407864998738) and all(r.k == 0.0 for r in out)


def test_unseen_category_raises(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "i int, c string")
    test = spark.createDataFrame([(3, "z")], "i int, c string")
    assert {(r.i, r.category_index) for r in I.one_hot_long(train, train, "i", "c").collect()} == {(1, 0), (2, 1)}
    with pytest.raises(Exception, match="unseen category z"):
        I.one_hot_long(test, train, "i", "c").collect()


def test_group_stats_equal_pandas(people):
    want = pdf(people).groupby("sex")["age"].agg(["min", "max", "mean", "std", "count"])
    for r in P.group_stats(people, ["sex"], "age").collect():
        assert np.allclose([r["min"], r["max"], r["mean"], r["std"], r["count"]], want.loc[r.sex].values)


def test_crosstab_counts_drop_null_keys(people):
    got = {(r.sex, r.ticket): r["count"] for r in P.crosstab(people, ["sex"], "ticket").collect()}
    assert got == {("f", "t1"): 2, ("f", "t2"): 1, ("m", "t2"): 2, ("m", "t3"): 1}
