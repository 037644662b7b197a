import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyfield.llm import alignment
from tallyfield.llm.varints import pack, unpack

from .conftest import CLASHING, EDGES

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "er", "in", " ", "  ", "a", "aa", "ing", "é", "日本", "😀", "\n", "▁", "x", "qu", "12", "http://", " an", "\t", "\x00", "한국", "<s>", "<|endoftext|>", "<0x41>", "'s", "\u2028"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    chars = {c: b for b, c in enumerate(byte_chars())}
    bytes_a = {i: bytes(chars[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, bytes_a, b, bytes_b


def byte_chars():
    other = iter(range(256, 512))
    return [chr(b) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256 else chr(next(other)) for b in range(256)]


def by_hand(libraries, rows):
    """The whole query by sets of end positions."""
    a, bytes_a, b, bytes_b = libraries
    cut, pairs = [], Counter()
    for i, text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [bytes_a[x] for x in ids[0]], [bytes_b[x] for x in ids[1]]
        if text and not (b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode()):
            ids, parts = ([], []), ([], [])
        ends = [dict(zip(np.cumsum([len(x) for x in p]).tolist(), t)) for p, t in zip(parts, ids)]
        both = sorted(set(ends[0]) & set(ends[1]))
        linked = [(ends[0][e], ends[1][e]) for e in both]
        pairs.update(linked)
        groups, last = [], 0
        for e in both:
            groups.append("|".join(",".join(str(t) for at, t in side.items() if last < at <= e) for side in ends))
            last = e
        cut.append((i, ids, linked, ";".join(groups)))
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (str(i), len(x), len(y), len(links), len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if x else "")
        for i, (x, y), links, g in cut
    )


def rows_of(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_groups_links_and_counts_equal_sets_of_ends(documents, libraries, monkeypatch):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30)))) for i in range(400)]
    rows += [(i, " ".join(draw.choice(["reading", "unbelievable", "tokens", "of", "the", "größe", "2024"]) for _ in range(60))) for i in range(400, 440)]
    rows += EDGES + [(9, "▁"), (10, "a▁b"), (11, " "), (12, "word " * 3000)]
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 300)
    assert rows_of(alignment.align_tokenizers(documents(rows, CLASHING), BYTES, PIECES)) == by_hand(libraries, rows)


def task(rows):
    """What a task makes of rows: its chunks, with the peak of memory that Python and NumPy took meanwhile."""
    df = type("Rows", (), {"schema": T.StructType([T.StructField("doc_id", T.LongType())])})
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["id", "text"])
    pair = alignment.tokenizer_pair(BYTES, PIECES)
    tracemalloc.start()
    try:
        made = list(alignment.chunks(pair, iter([batch]), 5, alignment._arrow(df, "doc_id")))
        return made, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_task_holds_counts_not_tokens_and_gives_memory_back(monkeypatch):
    gone = []
    monkeypatch.setattr(alignment, "let_go", lambda: gone.append(1))
    rows = [(i, f"the tokens of a text number {i} are counted, " * 90) for i in range(400)]
    made, peak = task(rows)
    assert sum(len(t) for _, t in rows) > 1_500_000
    assert [b.num_rows for b in made] == [401] and made[0]["chunk"].to_pylist()[0] == 5
    assert peak < 30 << 20
    assert gone == [1]


def test_parts_of_a_chunk_are_numbered_together(monkeypatch):
    draw = random.Random(8)
    rows = [(i, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30)))) for i in range(300)] + [(300, None), (301, "")]
    whole = task(rows)[0]
    monkeypatch.setattr(alignment, "PART_BYTES", 50)
    assert [b.to_pydict() for b in task(rows)[0]] == [b.to_pydict() for b in whole]
    assert len(whole) == 1 and whole[0]["pairs"].to_pylist()[-1] == sorted(set(whole[0]["pairs"].to_pylist()[-1]))
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 100)
    apart = task(rows)[0]
    assert len(apart) > 5 and sum(sum(b["totals"].to_pylist()[-1]) for b in apart) == sum(whole[0]["totals"].to_pylist()[-1])


def test_empty_table(documents):
    assert alignment.align_tokenizers(documents([]), BYTES, PIECES).collect() == []
    got = alignment.align_tokenizers(documents([(1, None), (2, "")]), BYTES, PIECES)
    assert rows_of(got) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
def test_common_ends_equal_an_intersection(share):
    draw = np.random.default_rng(5)
    for size in (0, 1, 2, 3, 17, 400, 5000):
        every = np.arange(1, size + 1)
        a, b = (np.union1d(every[draw.random(size) < share], [size + 1]) for _ in range(2))
        # long stretches on one diagonal
        a, b = np.concatenate([a, a[-1] + every + 1]), np.concatenate([b, a[-1] + every + 1])
        same, at_a, at_b = np.intersect1d(a, b, return_indices=True)
        got_a, got_b = alignment.common_ends(a.astype(np.int32), b.astype(np.int32))
        assert got_a.tolist() == at_a.tolist() and got_b.tolist() == at_b.tolist()


def test_arrays_that_end_apart():
    got = alignment.common_ends(np.array([2, 5, 9], np.int64), np.array([1, 2, 6, 7, 8], np.int64))
    assert [x.tolist() for x in got] == [[0], [1]]


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 40, (1 << 62) + 5])
    data, ends = pack(values)
    assert unpack(data).tolist() == values.tolist()
    assert unpack(data[ends[2] : ends[5]]).tolist() == values[3:6].tolist()
    assert unpack(pack(np.zeros(0, np.int64))[0]).tolist() == []


def test_both_ways_to_encode_bytes_agree(libraries, tmp_path):
    import json

    with open(BYTES, encoding="utf-8") as file:
        told = json.load(file)
    fast = alignment.ByteLevel(BYTES)
    told["pre_tokenizer"]["use_regex"] = True
    told["normalizer"] = {"type": "Sequence", "normalizers": []}  # one that does nothing, so the library is asked
    slow_path = tmp_path / "slow.json"
    slow_path.write_text(json.dumps(told))
    slow = alignment.ByteLevel(str(slow_path))
    for text in ("", " a b  c\n\n 12's <|endoftext|> größe 日本", "\t\x00x" * 50):
        assert list(fast.encode(text)) == list(slow.encode(text)) == libraries[0].encode(text, add_special_tokens=False).ids
