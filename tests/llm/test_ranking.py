import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyfield.llm import ranking

from .conftest import CLASHING, EDGES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(rows, items, top=20):
    docs = [(i, Counter(words(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def run(documents, spark, rows, items, more=()):
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranking.search(ranking.build_index(documents(rows, more)), asked).collect()), key=str)


@pytest.fixture()
def small(monkeypatch):
    for name, value in (("SHARD_BYTES", 6000), ("BLOCK", 4), ("ITEMS", 5), ("SENT_BYTES", 200)):
        monkeypatch.setattr(ranking, name, value)


def corpus(count, seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Größe", "日本", "É", "9"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(i, draw.choice([" ", ", ", "\n"]).join(draw.choices(vocabulary, weights, k=draw.randint(0, 60)))) for i in range(count)]


def test_equals_scoring_every_document(documents, spark, small):
    rows = corpus(700)
    rows += [(1000 + k, rows[3][1]) for k in range(60)] + EDGES
    items = [(k, rows[k * 7][1][:200]) for k in range(12)] + [(50, "w1 w1 W1 w2"), (51, None), (52, "-"), (53, "nowhere"), (54, rows[3][1]), (55, "größe ÉTÉ")]
    assert run(documents, spark, rows, items, CLASHING) == by_hand(rows, items)


def test_one_shard_by_default(documents, spark):
    rows, items = corpus(300, 2), [(k, " ".join(f"w{j}" for j in range(k, 60, 7))) for k in range(9)]
    assert run(documents, spark, rows, items) == by_hand(rows, items)


def test_items_with_one_id_stay_apart_and_empty_tables(documents, spark):
    rows = corpus(50, 4)
    got = run(documents, spark, rows, [(1, "w1 w5"), (1, "w9")])
    assert got == sorted(by_hand(rows, [(1, "w1 w5")]) + by_hand(rows, [(1, "w9")]), key=str)
    assert run(documents, spark, [], [(1, "a")]) == []
    assert run(documents, spark, [(1, None), (2, "")], [(1, "a")]) == []
    assert run(documents, spark, rows, []) == []


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    draw = np.random.default_rng(2)
    n, block = 4000, ranking.BLOCK
    lengths = np.full(n, 100)
    # six rows of the first block hold both terms often; elsewhere the common term's block bound is low
    rare = np.concatenate([np.arange(0, 60, 10), block + np.sort(draw.choice(n - block, 40, replace=False))])
    rare_times = np.where(rare < block, 50, 1)
    common, common_times = np.arange(n), np.where(np.arange(n) < block, 50, 1)

    def postings(rows, times):
        starts = np.arange(0, len(rows), block)
        gaps = np.diff(rows, prepend=0)
        gaps[starts] = rows[starts]
        data, ends = ranking.pack(np.stack([gaps, times], 1).ravel())
        last = np.append(starts[1:], len(rows)) - 1
        tops = np.maximum.reduceat(ranking.impact(times, lengths[rows]), starts)
        return ranking.Postings(tops, rows[last], ends[2 * last + 1], data.tobytes())

    lists = [(9000, postings(rare, rare_times)), (5000, postings(common, common_times))]
    unpacked = []
    monkeypatch.setattr(ranking, "unpack", lambda data, f=ranking.unpack: unpacked.append(len(data)) or f(data))
    rows, scores = ranking.best_rows(lists, lengths, np.arange(n), 5)
    want = np.zeros(n, np.int64)
    for w, own, times in ((9000, rare, rare_times), (5000, common, common_times)):
        want[own] += w * ranking.impact(times, lengths[own])
    order = np.lexsort((np.arange(n), -want))[:5]
    assert rows.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert len(unpacked) == 2 and unpacked[1] == 2 * block  # the rare list and one block of the common one


def test_length_beyond_64_bits():
    import pyarrow as pa

    shard = ranking._Shard()
    shard.add(pa.array([1]), [b"a " * 100000])
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("rows", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("tops", "lasts", "ends")), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
    head = next(shard.batches(0, 10**13, 10**15, schema))
    assert head["lengths"][0].as_py() == [75 + 25 * 100000 * 10**13 // 10**15]
