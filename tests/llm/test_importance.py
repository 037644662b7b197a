import random

import numpy as np
from pyspark.sql import functions as F

from tallyfield.llm.importance import features, largest_threshold, ngram_weights, resample, target_ids, weigh

from .conftest import CLASHING, EDGES


def corpus(n, seed=1):
    draw = random.Random(seed)
    clean, foul = [f"word{k}" for k in range(80)], ["rotten", "vile", "nasty"]
    for i in range(n):
        words = [draw.choice(clean) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[5], words[20], words[30] = foul
        yield i, " ".join(words), bad


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_bad_rows_are_left_out(spark, documents):
    data = list(corpus(600))
    marked = labels(spark, [(i, int(not bad), 0) for i, _, bad in data[:300]])
    docs = documents([(i, t) for i, t, _ in data])
    ids, share = target_ids(marked, (F.col("quality") == 1) & (F.col("toxic") == 0))
    assert len(ids) == 225 and share == 0.75
    got = {r.doc_id: r.kept for r in resample(weigh(docs, ngram_weights(docs, ids, "doc_id", "text", 1 << 12)), share).collect()}
    assert sum(got.values()) == 450
    bad = [i for i, _, b in data if b]
    assert sum(got[i] for i in bad) <= 3


def test_weights_equal_counting(documents):
    data = list(corpus(40))
    docs = documents([(i, t) for i, t, _ in data])
    size, wanted = 1 << 10, {1, 2, 3}
    got = ngram_weights(docs, wanted, "doc_id", "text", size)
    raw, good = np.zeros(2 * size), np.zeros(2 * size)
    for i, t, _ in data:
        np.add.at(raw, features(t.encode(), size), 1)
        if i in wanted:
            np.add.at(good, features(t.encode(), size), 1)
    for half, extra in ((slice(0, size), 20), (slice(size, None), 100)):
        share = good[half].sum() / raw[half].sum()
        assert np.allclose(got[half], np.log((good[half] + extra * share) / (raw[half] + extra) / share))


def test_noise_is_gumbel(documents):
    docs = documents([(i, "") for i in range(4000)])
    keys = np.array([r.key for r in weigh(docs, np.zeros(32)).collect()])
    assert abs(keys.mean() - 0.5772) < 0.08 and abs(keys.std() - 1.2825) < 0.08


def test_threshold_is_exact(spark):
    draw = np.random.default_rng(3)
    values = [*draw.normal(size=3000).tolist(), *([0.25] * 500), -1e300, 1e300, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    down = sorted(values, reverse=True)
    for count in (1, 2, 700, 1500, 2000, len(values)):
        assert largest_threshold(df, "x", count) == down[count - 1]
    assert largest_threshold(df.limit(0), "x", 1) is None


def test_edges(spark, documents):
    docs = documents(EDGES, CLASHING)
    out = resample(weigh(docs, ngram_weights(docs, [4, 7], "doc_id", "text", 64)), 0.5).collect()
    assert len(out) == len(EDGES)
    assert all(r.n_ngrams == 0 and r.log_weight == 0 for r in out if r.doc_id in (1, 2, 3))
    assert len({(r.key, r.kept) for r in out if r.doc_id == 5}) == 1
    flat = ngram_weights(docs, [], "doc_id", "text", 64)
    assert not flat.any()
    assert resample(weigh(documents([]), flat), 0.5).count() == 0
    assert target_ids(labels(spark, []), F.lit(True)) == ([], 1.0)
