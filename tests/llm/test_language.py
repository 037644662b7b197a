import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyfield.llm.language import CodeIndex, _codes, _least_count, coded_text, count_corpus, learn_bytes, score

from .conftest import CLASHING, EDGES

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TOKEN.findall(text or "")]


def out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


class Trie:
    """Prediction by partial matching written out: dictionaries of counts, escapes one order at a time."""

    def __init__(self, texts, order, least=1):
        self.order, self.all, self.kept = order, defaultdict(Counter), {}
        for t in texts:
            data = b"\n" * order + coded_text([w.encode() for w in tokens(t)])
            for at in range(order, len(data)):
                for k in range(order + 1):
                    self.all[data[at - k : at]][data[at]] += 1
        for context, seen in self.all.items():
            if some := {b: n for b, n in seen.items() if n >= least}:
                self.kept[context] = some

    def share(self, before, byte):
        excluded, p = set(), 1.0
        for k in range(self.order, -1, -1):
            context = before[len(before) - k :]
            if context not in self.kept:
                continue
            seen = {b: n for b, n in self.kept[context].items() if b not in excluded}
            total = sum(n for b, n in self.all[context].items() if b not in excluded)
            if total:
                if byte in seen:
                    return p * (seen[byte] - 0.5) / total
                p *= (total - sum(seen.values()) + 0.5 * len(seen)) / total
            excluded |= set(seen)
        return p / (256 - len(self.kept.get(b"", {})))

    def score(self, text):
        data = b"\n" * self.order + coded_text([w.encode() for w in tokens(text)])
        return sum(math.log10(self.share(data[:at], data[at])) for at in range(self.order, len(data)))


def corpus(n, seed=3):
    draw = random.Random(seed)
    parts = ["tion", "ent", "the", "er", "été", "日", "A", "b"]
    rows = [(i, " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(0, 25)))) for i in range(n)]
    return rows + [(n, "Only  here\nqq")]


def test_code_index():
    draw = np.random.default_rng(1)
    codes = np.unique(draw.integers(0, 1 << 60, 5000))
    index = CodeIndex(codes)
    assert (index.find(codes) == np.arange(len(codes))).all()
    assert (index.find(codes + 1)[~np.isin(codes + 1, codes)] == -1).all()
    assert (CodeIndex(codes[:0]).find(codes) == -1).all()


@pytest.mark.parametrize("most", [1 << 20, 150])
def test_shares_equal_the_trie_and_sum_to_one(documents, most):
    rows = corpus(80)
    model = learn_bytes(count_corpus(documents(rows), "doc_id", "text", 3), 3, most)
    assert len(model.strings) <= most
    least = int(model.counts.min())
    trie = Trie([t for i, t in rows if not out(i)], 3, least)
    for text in [t for i, t in rows if out(i)] + ["zz ñ", ""]:
        codes = _codes([coded_text([w.encode() for w in tokens(text)])], 3)
        assert model.log_shares(codes).sum() == pytest.approx(trie.score(text), rel=1e-9)
    for code in codes.tolist() + _codes([b"the ent"], 3).tolist():
        every = np.array([code >> 8 << 8 | b for b in range(256)])
        assert (10 ** model.log_shares(every)).sum() == pytest.approx(1)


@pytest.mark.parametrize("words", [1 << 17, 5])
def test_base_score_equals_formula(documents, words):
    rows = [*corpus(60), *EDGES]
    counts = Counter()
    for i, t in rows:
        if not out(i):
            counts.update([*tokens(t), "\n"])
    total, bottom = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = sorted(
        (str(i), out(i), len(own := [*tokens(t), "\n"]), sum(w in counts for w in own), total, round(sum(math.log10((counts[w] + 0.5) / bottom) for w in own), 6))
        for i, t in rows
    )
    got = score(documents(rows, CLASHING), order=2, most_words=words).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


@pytest.mark.parametrize("order", [1, 3, 5])
@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_score_keeps_all_strings(documents, most, order):
    rows = [*corpus(60), *EDGES]
    trie = Trie([t for i, t in rows if not out(i)], order)
    got = score(documents(rows, CLASHING), order=order, most_strings=most).collect()
    want = sorted((str(i), round(trie.score(t), 5)) for i, t in rows)
    assert [i for i, _ in want] == [i for i, _ in sorted((str(r.doc_id), round(r.score, 5)) for r in got)]
    for (_, a), (_, b) in zip(want, sorted((str(r.doc_id), r.score) for r in got)):
        assert a == pytest.approx(b, abs=1e-4)


def test_bound_on_rows_holds(spark):
    counts = spark.createDataFrame([(n,) for n in [*([100] * 50), *([101] * 5), 7, 7, 3]], "n long")
    for most in (0, 4, 5, 54, 55, 56, 57, 58, 100):
        least = _least_count(counts, most)
        assert counts.filter(f"n >= {least}").count() <= most
    assert _least_count(counts, 100) == 3


def test_same_text_same_score_and_long_texts(documents):
    rows = [(i, "the same text") for i in range(20)] + [(100, "tion " * 60_000)]
    got = score(documents(rows)).collect()
    assert len({r.score for r in got if r.doc_id < 100}) == 1
    assert all(r.score < 0 for r in got)


def test_no_rows_and_no_training_rows(documents):
    assert score(documents([])).count() == 0
    only = next(i for i in range(100) if out(i))
    r = score(documents([(only, "ab")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert r.score == pytest.approx(-3 * math.log10(256))
