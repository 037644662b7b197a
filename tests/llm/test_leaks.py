import random

import numpy as np

from tallyfield.llm.leaks import PIECED, SHARE, anchors, clean_documents, edit_distance, item_keys, key_filter, leaked_items, most_edits, word_hashes

from .conftest import CLASHING, EDGES


def words(draw, n):
    return ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 7))) for _ in range(n)]


def edited(draw, item, edits):
    out = list(item)
    for _ in range(edits):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        if kind == 0:
            out[at] = "EDIT" + str(draw.random())
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "more")
    return out


def brute_distance(item, text, most):
    """Least word edits between the item and any run of the text, cell by cell."""
    line = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, line[0] = line[:], i
        for j, b in enumerate(text, 1):
            line[j] = min(before[j - 1] + (a != b), before[j] + 1, line[j - 1] + 1)
    return min(line) if min(line) <= most else None


def test_edit_distance_equals_cells():
    draw = random.Random(1)
    for _ in range(400):
        item = [draw.randrange(6) for _ in range(draw.randint(1, 9))]
        text = [draw.randrange(6) for _ in range(draw.randint(0, 14))]
        most = draw.randint(0, 4)
        assert edit_distance(item, text, most) == brute_distance(item, text, most)


def test_anchors_are_local():
    draw = random.Random(2)
    item = word_hashes(" ".join(words(draw, 40)).encode())
    text = np.concatenate([word_hashes(" ".join(words(draw, 30)).encode()), item, word_hashes(b"x y z")])
    assert set(anchors(item) + 30) <= set(anchors(text))


def test_recall_against_all_alignments(spark, documents):
    draw = random.Random(5)
    items = [words(draw, draw.randint(15, 59)) for _ in range(40)] + [["yes", "no", "maybe"], words(draw, 12)]
    docs, clean = [], 0
    for i in range(400):
        body = words(draw, draw.randint(20, 120))
        if i % 2:
            item = items[draw.randrange(len(items))]
            edits = draw.randint(0, int(SHARE * len(item)))
            at = draw.randrange(len(body))
            body[at:at] = edited(draw, item, edits)
        docs.append((i, "  ".join(body).capitalize()))
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    want = {}
    hashed = [word_hashes(" ".join(w).encode()).view(np.int64).tolist() for w in items]
    for i, text in docs:
        own = word_hashes(text.encode()).view(np.int64).tolist()
        for k, item in enumerate(hashed):
            most = int(SHARE * len(item))
            d = edit_distance(item, own, most)
            if d is not None:
                want[i, k] = d
    got = {(r.doc_id, r.item_id): r.distance for r in leaked_items(documents(docs, CLASHING), table).collect()}
    assert set(got) <= set(want) and len(want) > 150
    assert len(got) >= 0.95 * len(want)
    assert all(got[p] == want[p] for p in got)
    left = clean_documents(documents(docs), leaked_items(documents(docs), table))
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_recall_by_length_and_edits(spark, documents):
    """Every copy of an item of 1 to 35 words is found, with every number of edits that its length allows."""
    draw = random.Random(8)
    items, docs = [], []
    for size in range(1, PIECED):
        for edits in range(most_edits(size, SHARE) + 1):
            for _ in range(3):
                item = [str(draw.random()) for _ in range(size)]
                before, after = ([str(draw.random()) for _ in range(draw.randint(0, 12))] for _ in range(2))
                docs.append((len(items), " ".join(before + edited(draw, item, edits) + after)))
                items.append((len(items), " ".join(item)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(documents(docs), table).collect()}
    assert got == {(k, k) for k, _ in items}


def test_pieces_of_other_shares(spark, documents):
    draw = random.Random(9)
    item = [str(draw.random()) for _ in range(10)]
    far = edited(draw, item, 4)
    table = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = documents([(0, " ".join(["x", *item, "y"])), (1, " ".join(["x", *far, "y"]))])
    assert {r.doc_id for r in leaked_items(docs, table, share=0.0).collect()} == {0}
    assert {r.doc_id for r in leaked_items(docs, table, share=0.4).collect()} == {0, 1}


def test_filter_has_no_false_negatives(spark):
    draw = random.Random(6)
    table = spark.createDataFrame([(k, " ".join(words(draw, 30))) for k in range(30)], "item_id long, text string")
    keys = item_keys(table, "item_id", "text")
    slots = key_filter(keys)
    for r in keys.select("key").collect():
        key = np.array([r.key], np.int64).view(np.uint64)
        assert slots[(key >> np.uint64(8)) & np.uint64(len(slots) - 1)] and slots[(key >> np.uint64(36)) & np.uint64(len(slots) - 1)]


def test_edges(spark, documents):
    passage = "a passage of the benchmark that is long enough to be found again word for word"
    items = spark.createDataFrame(
        [(1, passage), (1, passage), (None, "an item without id but with words enough to be found here"), (3, None), (4, ""), (5, "one")],
        "item_id long, text string",
    ).selectExpr("*", "1 as key", "2 as place")
    rows = [*EDGES, (20, f"Before {passage.upper()} after"), (20, f"Before {passage.upper()} after"), (None, passage), (21, "w " * 60_000 + passage)]
    got = {(r.doc_id, r.item_id, r.distance) for r in leaked_items(documents(rows, CLASHING), items).collect()}
    assert got == {(20, 1, 0), (None, 1, 0), (21, 1, 0), (4, 5, 0)}
    assert leaked_items(documents([]), items).count() == 0
    assert leaked_items(documents(rows), items.limit(0)).count() == 0
    left = clean_documents(documents(rows), leaked_items(documents(rows), items))
    assert left.count() == len(EDGES) - 3 and left.columns == documents(rows).columns
