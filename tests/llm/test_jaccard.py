import random
import re

import numpy as np
import pytest

from tallyfield.llm import jaccard
from tallyfield.llm.components import components
from tallyfield.llm.jaccard import bitmap, bits_of, exact_links, fold, one_of_each, possible_links, similar_groups

from .conftest import CLASHING, EDGES


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(size, smallest id of the component) of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    return sorted((str(i), len(sets[k]), str(low.get(top(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def corpus(seed, families=12, members=14, common=None):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghijkl") for _ in range(draw.randint(1, 4)))
    rows, i = [], 0
    for _ in range(families):
        seed_text = [word() for _ in range(draw.randint(3, 90))]
        for _ in range(draw.randint(1, members)):
            text = list(seed_text)
            for _ in range(draw.randint(0, 4)):
                at = draw.randrange(len(text))
                text[at : at + draw.randint(0, 2)] = [word() for _ in range(draw.randint(0, 2))]
                text = text or ["x"]
            if common and draw.random() < 0.5:
                text = [*common, *text]
            rows.append((i * 7 % 1009, " ".join(text).title() if draw.random() < 0.3 else "\n".join(text)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(documents, seed):
    rows = corpus(seed, common="this passage stands in many texts and is not enough to link them".split())
    assert result(similar_groups(documents(rows, CLASHING))) == brute(rows)


def test_large_groups_and_parts(documents, monkeypatch):
    """Few pairs a shingle, small parts and small leaves take every path on few rows."""
    monkeypatch.setattr(jaccard, "PAIRED", 3)
    monkeypatch.setattr(jaccard, "PART", 400)
    monkeypatch.setattr(jaccard, "GROUP", 5)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    monkeypatch.setattr(jaccard, "HOT_IN_TASK", 2)
    rows = corpus(4, families=4, members=40)
    assert result(similar_groups(documents(rows).repartition(4))) == brute(rows)


def test_link_is_exact_at_the_limit(documents):
    # 9 shingles each, 8 common: 8 of 10 united links; 8 and 9 with 7 common: 7 of 10 does not
    a = [f"w{k}" for k in range(13)]
    b = [*a[:12], "other"]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*a[:11], "third"]))]
    assert brute(rows) == result(similar_groups(documents(rows)))
    assert result(similar_groups(documents(rows)))[1][2] == "1"


def test_tree_finds_every_connection():
    draw = np.random.default_rng(2)
    for _ in range(20):
        base = [np.unique(draw.integers(0, 1 << 60, draw.integers(1, 120)).astype(np.uint64)) for _ in range(6)]
        sets = []
        for _ in range(90):
            s = base[draw.integers(6)]
            s = np.unique(np.concatenate([s[draw.random(len(s)) < 0.93], draw.integers(0, 1 << 60, draw.integers(0, 3)).astype(np.uint64)]))
            sets.append(s if len(s) else base[0])
        label, want = list(range(90)), list(range(90))
        for p, q in exact_links(sets):
            label = [label[p] if x == label[q] else x for x in label]
        for p in range(90):
            for q in range(p):
                both = len(np.intersect1d(sets[p], sets[q]))
                if 100 * both >= 80 * (len(sets[p]) + len(sets[q]) - both):
                    want = [want[p] if x == want[q] else x for x in want]
        same = lambda x: [[a == b for a in x] for b in x]
        assert same(label) == same(want)
        # what the bitmaps leave possible connects at least as much
        sizes = np.array([len(s) for s in sets])
        wide = list(range(90))
        for p, q in possible_links(sizes, [bitmap(s, bits_of(len(s))) for s in sets]):
            wide = [wide[p] if x == wide[q] else x for x in wide]
        assert all(wide[p] == wide[q] for p in range(90) for q in range(p) if want[p] == want[q])


def test_folded_bitmaps():
    items = np.random.default_rng(1).integers(0, 1 << 62, 300).astype(np.uint64)
    assert (fold(bitmap(items, 1024), 16) == bitmap(items, 128)).all()
    assert bits_of(1) == 64 and bits_of(65) == 128 and bits_of(10**9) == 8192


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(documents):
    rows = [*EDGES, (30, "a b c d"), (31, "A  B\nC D"), (32, "a b c d e"), (33, "long " + " ".join(map(str, range(30_000))))]
    assert result(similar_groups(documents(rows, CLASHING))) == brute(rows)
    assert similar_groups(documents([])).count() == 0


def test_one_row_of_each_group_stays(documents):
    rows = [
        *corpus(6, families=6),
        (5000, "exactly the same words in this row and that row"),
        (5000, "exactly the same words in this row and that row"),
        (5001, "exactly the same words in this row and that row"),
        (0, "an id that goes elsewhere but whose other row is alone here"),
        (None, None),
        (6000, ""),
        (6000, ""),
    ]
    docs = documents(rows, CLASHING)
    left = one_of_each(docs)
    assert left.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    empty = sum(not shingles(t) for _, t in rows)
    assert len(kept) - sum(not shingles(t) for _, t in kept) == _classes(rows)
    assert sum(not shingles(t) for _, t in kept) == empty
    assert set(kept) <= set(rows)


def _classes(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    return len({label[k] for k in range(len(rows)) if sets[k]})
