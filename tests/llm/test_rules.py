import itertools
import random
import re

import numpy as np

from tallyfield.llm.rules import FEATURES, ChainModel, describe, fit_chain, fit_rules, judge, keep_good

from .conftest import CLASHING, EDGES


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for k in range(len(words) - 4):
        at.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        copies += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)


def test_counts_equal_brute_force():
    draw = random.Random(2)
    parts = ["a", "b", "été", "x|y", "#", " ", " ", "\n", "\n", "\t", "\x0b", "a b c d e f", "line\n", "\xa0", "日 本"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) + draw.choice([" ", ""]) for _ in range(draw.randint(0, 40)))
        d = describe(text.encode())
        assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words) == brute(text), text


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(1)
    for _ in range(60):
        model = ChainModel(np.zeros(FEATURES), np.ones(FEATURES), draw.normal(size=(2, FEATURES)), draw.normal(size=(2, 2)))
        x = draw.normal(size=(draw.integers(1, 7), FEATURES))
        own = model.scores(x)
        total = lambda p: sum(own[i, k] for i, k in enumerate(p)) + sum(model.between[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=len(x)), key=total)
        assert model.viterbi(x).tolist() == list(best)


def lines(draw, junk):
    word = lambda: "".join(draw.choice("abcdeilnorst") for _ in range(draw.randint(2, 8)))
    if junk:
        return " ".join(word().upper() + "!!" for _ in range(draw.randint(3, 12)))
    return " ".join(word() for _ in range(draw.randint(5, 15))).capitalize() + "."


def corpus(n, seed):
    draw = random.Random(seed)
    for i in range(n):
        bad = i % 4 == 0
        yield i, "\n".join(lines(draw, bad and draw.random() < 0.9) for _ in range(draw.randint(2, 9))), int(not bad)


def test_learns_planted_lines():
    data = list(corpus(300, 7))
    model = fit_chain([describe(t.encode()).features for _, t, _ in data], [q for *_, q in data])
    right = sum((model.content_share(describe(t.encode())) >= 0.5) == bool(q) for _, t, q in corpus(300, 8))
    assert right >= 294


def test_verdicts(spark, documents):
    data = list(corpus(200, 9))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents([*((i, t) for i, t, _ in data), *((1000 + k, t) for k, (_, t) in enumerate(EDGES))], CLASHING[:9])
    model = fit_rules(docs, labels)
    got = {}
    rows = judge(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got[r.doc_id] = r
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert sum(got[i].kept == bool(q) or got[i].base_failed for i, _, q in data) >= 196
    kept = keep_good(docs, model)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "one two three four five six seven eight nine ten eleven"), (2, None)])
    assert fit_rules(docs, none) is None
    assert {r.doc_id: r.kept for r in judge(docs, None).collect()} == {1: True, 2: False}
    assert judge(documents([]), None).count() == 0
