import heapq

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyfield.learning import trees as T


def vectors(spark, x, y, more=()):
    names = [f"f{k}" for k in range(x.shape[1])]
    rows = [(*map(float, a), int(b), *m) for a, b, m in zip(x, y, more or [()] * len(y))]
    extra = ", val boolean" if more else ""
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y int" + extra)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    x = np.round(2 * rng.normal(size=(500, 4))) / 2
    p = 1 / (1 + np.exp(-2 * (x[:, 0] > 0.3) + 1.5 * x[:, 1] * (x[:, 2] > 0)))
    return x, (rng.random(500) < p).astype(int)


def by_hand(x, y, params, rounds):
    """Boosting of the log loss with every distinct value as a cut, node by node; margins after all rounds."""
    margin = np.zeros(len(y))

    def worth(g, h):
        return max(abs(g) - params.reg_alpha, 0) ** 2 / (h + params.reg_lambda)

    def grow(rows, depth, g, h):
        best = (1e-12, None, None)
        if depth < params.max_depth:
            for k in range(x.shape[1]):
                for cut in np.unique(x[rows, k])[:-1]:
                    left = rows[x[rows, k] <= cut]
                    right = np.setdiff1d(rows, left)
                    if min(h[left].sum(), h[right].sum()) < params.min_child_weight:
                        continue
                    gain = 0.5 * (worth(g[left].sum(), h[left].sum()) + worth(g[right].sum(), h[right].sum()) - worth(g[rows].sum(), h[rows].sum())) - params.gamma
                    if gain > best[0] + 1e-9:
                        best = (gain, left, right)
        if best[1] is not None:
            grow(best[1], depth + 1, g, h)
            grow(best[2], depth + 1, g, h)
            return
        total = g[rows].sum()
        margin[rows] += -params.learning_rate * np.sign(total) * max(abs(total) - params.reg_alpha, 0) / (h[rows].sum() + params.reg_lambda)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), 0, p - y, p * (1 - p))
    return margin


@pytest.mark.parametrize(
    "params",
    [
        T.Boosting(n_estimators=3, max_depth=2, learning_rate=0.5),
        T.Boosting(n_estimators=3, max_depth=3, reg_lambda=5.0, reg_alpha=2.0),
        T.Boosting(n_estimators=2, max_depth=4, reg_lambda=0.0, min_child_weight=10.0, gamma=1.5),
        T.Boosting(n_estimators=2, max_depth=3, gamma=1e6),
    ],
)
def test_leaf_weights_equal_a_computation_by_hand(spark, table, params):
    x, y = table
    model = T.fit_boosting(vectors(spark, x, y), "y", params)
    want = by_hand(x, y, params, params.n_estimators)
    assert model.predict(x) == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-9)
    if params.gamma > 1e5:
        assert all(t.leaves() == 1 for t in model.trees)


def test_penalties_of_one_leaf():
    p = T.Boosting(reg_lambda=2.0, reg_alpha=1.0)
    assert p.weight(-5.0, 3.0) == pytest.approx(4 / 5) and p.weight(0.5, 3.0) == 0 and p.weight(3.0, 0.0) == pytest.approx(-1.0)


def test_margins_written_between_rounds_change_nothing(spark, table, monkeypatch):
    x, y = table
    df = vectors(spark, x, y)
    params = T.Boosting(n_estimators=5, max_depth=2)
    whole = T.fit_boosting(df, "y", params).predict(x)
    monkeypatch.setattr(T, "WRITTEN", 2)
    assert T.fit_boosting(df, "y", params).predict(x) == pytest.approx(whole, abs=1e-12)


def test_patience_keeps_the_best_round(spark, table):
    x, y = table
    rng = np.random.default_rng(6)
    val = rng.random(len(y)) < 0.4
    noise = np.where(rng.random(len(y)) < 0.3, 1 - y, y)
    df = vectors(spark, x, noise, [(bool(v),) for v in val])
    params = T.Boosting(n_estimators=40, max_depth=4, learning_rate=0.6, patience=4)
    model = T.fit_boosting(df, "y", params, validation="val")
    losses = []
    for k in range(1, len(model.trees) + 5):
        full = T.fit_boosting(df.where("not val"), "y", T.Boosting(n_estimators=k, max_depth=4, learning_rate=0.6)) if k > len(model.trees) else T.TreeModel(model.edges, model.trees[:k], True)
        p = full.predict(x[val])
        losses.append(-np.mean(np.log(np.where(noise[val] == 1, p, 1 - p))))
    assert len(model.trees) < 40 and int(np.argmin(losses)) + 1 == len(model.trees)


def test_column_and_row_samples(spark, table):
    x, y = table
    model = T.fit_boosting(vectors(spark, x, y), "y", T.Boosting(n_estimators=12, max_depth=3, colsample_bytree=0.5, subsample=0.6))
    used = [{f for f in t.feature if f >= 0} for t in model.trees]
    assert all(len(u) <= 2 for u in used) and len(set().union(*used)) == 4
    draw = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 40_000)
    w = np.where(np.arange(40_000) % 2, 1.0, 50.0)
    part = T.sampled(draw, w, 3, 0.7)
    assert part[w == 1].mean() == pytest.approx(0.7, abs=0.02) and set(part[w == 50]) == {35.0}
    again = T.sampled(draw, np.ones(40_000), 3, 1.0, replace=True)
    assert again.mean() == pytest.approx(1, abs=0.03) and again.var() == pytest.approx(1, abs=0.05) and (again == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert not np.array_equal(part, T.sampled(draw, w, 4, 0.7))


def test_weights_stand_for_rows(spark, table):
    x, y = table
    df = vectors(spark, x, y).withColumn("w", (1 + F.col("y") * 2).cast("double"))
    each = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    params = T.Boosting(n_estimators=2, max_depth=3)
    assert T.fit_boosting(df, "y", params, weight="w").predict(x) == pytest.approx(T.fit_boosting(each, "y", params).predict(x), abs=1e-9)


def test_random_cuts_are_uniform_in_the_range_of_the_node():
    edges = np.array([0.0, 1.0, 2.0, 10.0])
    rng = np.random.default_rng(2)
    cuts = np.bincount([T.random_cut(edges, 20.0, 0, 4, rng) for _ in range(20_000)], minlength=5) / 20_000
    assert cuts == pytest.approx([0.05, 0.05, 0.4, 0.5, 0], abs=0.015)  # by the lengths of the bins above each cut
    assert {T.random_cut(edges, 20.0, 1, 3, rng) for _ in range(200)} == {1, 2}
    assert {T.random_cut(edges, 20.0, 2, 3, rng) for _ in range(50)} == {2}


def test_forests_cap_their_leaves_by_gain(spark, table):
    x, y = table
    df = vectors(spark, x, y)
    whole = T.fit_forest(df, "y", T.Forest(n_estimators=6, max_depth=5, random_cuts=True))
    capped = T.fit_forest(df, "y", T.Forest(n_estimators=6, max_depth=5, random_cuts=True, max_leaf_nodes=5))
    deep = T.fit_forest(df, "y", T.Forest(n_estimators=6, max_depth=4, random_cuts=True))
    assert max(t.leaves() for t in whole.trees) > 5
    for t, full in zip(capped.trees, deep.trees):
        assert t.leaves() <= 5
        # the same splits as taking the greatest gain among the open nodes, one after another
        open_, taken = [(-full.gain[0], 0)], []
        while open_ and len(taken) < 4:
            gain, node = heapq.heappop(open_)
            if full.left[node] >= 0:
                taken.append(-gain)
                for child in (full.left[node], full.right[node]):
                    heapq.heappush(open_, (-full.gain[child], child))
        assert sorted(g for g in t.gain if g > 0) == pytest.approx(sorted(taken))
    assert len({tuple(t.cut) for t in whole.trees}) > 1


def test_forest_values_are_shares_of_the_leaf(spark, table):
    x, y = table
    model = T.fit_forest(vectors(spark, x, y), "y", T.Forest(n_estimators=3, max_depth=3, random_cuts=False, features=4))
    bins = T.binned(x, model.edges)
    for t in model.trees:
        at = t.nodes(bins)
        for leaf in set(at.tolist()):
            assert t.value[leaf] == pytest.approx(y[at == leaf].mean())
    # without chance all trees begin alike, with the greatest fall of impurity
    assert len({(t.feature[0], t.cut[0]) for t in model.trees}) == 1

    def impurity(v):
        return len(v) - (v.sum() ** 2 + (len(v) - v.sum()) ** 2) / len(v)

    falls = [impurity(y) - impurity(y[x[:, k] <= c]) - impurity(y[x[:, k] > c]) for k in range(4) for c in np.unique(x[:, k])[:-1]]
    assert model.trees[0].gain[0] == pytest.approx(max(falls))


def test_one_class_and_no_rows(spark, table):
    x, _ = table
    df = vectors(spark, x[:20], np.ones(20, int))
    assert T.fit_forest(df, "y", T.Forest(n_estimators=2)).predict(x[:3]).tolist() == [1, 1, 1]
    assert (T.fit_boosting(df, "y", T.Boosting(n_estimators=2)).predict(x[:3]) > 0.5).all()
    with pytest.raises(ValueError):
        T.fit_boosting(df.limit(0), "y", T.Boosting())
    got = df.select(T.fit_forest(df, "y", T.Forest(n_estimators=2)).probability().alias("p")).distinct().collect()
    assert [r.p for r in got] == [1.0]


def folded(spark, table):
    x, y = table
    return vectors(spark, x, y).withColumn("fold", F.pmod(F.xxhash64("features"), F.lit(3)).cast("int"))


def test_forests_of_all_folds_grow_as_they_would_alone(spark, table):
    df = folded(spark, table)
    forests = [T.Forest(3, 4), T.Forest(2, 6, 5, random_cuts=False, features=4), T.Forest(2, 3, bootstrap=True)]
    scores = T.search_forests(df, "y", forests, folds=3)
    assert [(s["candidate"], s["fold"]) for s in scores] == [(c, f) for c in range(3) for f in range(3)]
    edges, tops = T.feature_edges(df), T.greatest(df, 4)
    rows = T.binned_rows(df, "y", edges, fold="fold")
    for s in scores:
        p, f = forests[s["candidate"]], s["fold"]
        alone = T.grow(rows.where(F.col("fold") != f), edges, tops, [T.Job(p, t) for t in range(p.n_estimators)])
        part = rows.where(F.col("fold") == f).toPandas()
        bins = np.stack([np.frombuffer(b, np.uint8) for b in part.bins]).astype(int)
        right = ((np.mean([t.values(bins) for t in alone], axis=0) > 0.5) == (part.y > 0.5)).sum()
        assert (s["tested"], s["right"]) == (len(part), right) and s["trees"] == p.n_estimators


def test_halving_gives_trees_to_the_best(spark, table, monkeypatch):
    df = folded(spark, table)
    forests = [T.Forest(16, 1 + k % 4, features=1 + k % 4) for k in range(8)]
    whole = T.search_forests(df, "y", forests, folds=3)
    passes = []
    monkeypatch.setattr(T, "summed", lambda *a, f=T.summed: passes.append(1) or f(*a))
    scores = T.search_forests(df, "y", forests, folds=3, first=4, share=0.5)
    trees = {s["candidate"]: (s["trees"], s["last"]) for s in scores}
    assert sorted(trees.values()) == [(4, 0)] * 4 + [(8, 1)] * 2 + [(16, 2)] * 2
    # who got all trees has the same scores as without halving
    full = {c for c, (n, _) in trees.items() if n == 16}
    key = lambda s: (s["candidate"], s["fold"], s["right"])
    assert [key(s) for s in scores if s["candidate"] in full] == [key(s) for s in whole if s["candidate"] in full]
    assert T.winner(scores) in full and T.winner(whole) == max(range(8), key=lambda c: (np.mean([s["score"] for s in whole if s["candidate"] == c]), -c))
    assert len(passes) <= 3 * (4 + 1)


def test_expanding_forests_read_earlier_folds_only(spark, table):
    df = folded(spark, table)
    rows, edges, tops = T.binned_rows(df, "y", T.feature_edges(df), fold="fold"), T.feature_edges(df), T.greatest(df, 4)
    late = T.grow(rows, edges, tops, [T.Job(T.Forest(1, 3), 0, 2)], expanding=True)
    alone = T.grow(rows.where("fold < 2"), edges, tops, [T.Job(T.Forest(1, 3), 0)])
    assert late == alone
