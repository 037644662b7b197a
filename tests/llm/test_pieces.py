import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from tallyfield.llm import pieces
from tallyfield.llm.pieces import MARK, PieceModel, decode_pieces, encode_pieces
from tallyfield.llm.wordpieces import count_word_pieces, model_trie

from .conftest import CLASHING, EDGES

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "er", "in", " ", "  ", "a", "aa", "ing", "é", "日", "本", "😀", "\n", MARK, "x", "qu", "Z", "12", "http://", " an", "\t", "é", "\x00", "한국", "<s>", "нет"]


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    draw = random.Random(1)
    for i in range(6000):
        if i % 3 == 0:
            yield "".join(draw.choice("abeinrst th") for _ in range(draw.randint(0, 40)))
        elif i % 7 == 0:
            yield draw.choice("a e=-") * draw.randint(1, 90)
        else:
            yield "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12)))


def test_ids_and_texts_equal_the_library(model, library):
    for text in texts():
        ids = model.encode(text).tolist()
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_units_together_and_alone(model, library):
    long = "antidisestablishment" * 200
    shared = [*list(texts())[:300], long, "", "a" * 63, "a" * 64, "a" * 65, "the " * 500, "日本語 text ñandú ÉTÉ Ǆ\n\n\n x"]
    assert [x.tolist() for x in model.encode_all(shared)] == [library.encode(t) for t in shared]
    assert model.encode_all([]) == [] and model.encode("").tolist() == []


def test_tested_pairs_that_share_a_slot(library, monkeypatch):
    monkeypatch.setattr(pieces, "SLOTS", 4)
    small = PieceModel(PATH)
    shared = list(texts())[:200]
    assert [x.tolist() for x in small.encode_all(shared)] == [library.encode(t) for t in shared]


def test_edges(documents, library):
    got = encode_pieces(documents(EDGES, CLASHING), PATH).collect()
    want = sorted((str(i), library.encode(t or "")) for i, t in EDGES)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.decoded == library.decode(r.ids) for r in got)
    assert encode_pieces(documents([]), PATH).count() == 0


def test_decode_alone(spark, library):
    rows = [(1, [451, 28718, 911]), (2, []), (3, None), (4, [3, 200, 259])]
    got = {r.doc_id: r.decoded for r in decode_pieces(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {i: library.decode(x or []) for i, x in rows}


def greedy(word, begins, continues):
    at, count = 0, 0
    while at < len(word):
        entries = continues if at else begins
        end = next((e for e in range(len(word), at, -1) if word[at:e] in entries), None)
        if end is None:
            return 0
        at, count = end, count + 1
    return count


def test_piece_counts_equal_greedy_matching_and_the_library(model):
    trie = model_trie(PATH)
    begins = {p[1:] for p in model.ids if p.startswith(MARK) and MARK not in p[1:]} - {""}
    continues = {p for p in model.ids if MARK not in p}
    vocabulary = {w: k for k, w in enumerate([*begins, *("##" + p for p in continues), "[UNK]"])}
    library = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6))
    for text in list(texts())[:2500]:
        for word in text.replace("\x00", "").split():
            n = trie.pieces(word)
            assert n == greedy(word, begins, continues)
            tokens = library.encode(word).tokens
            assert n == (0 if tokens == ["[UNK]"] else len(tokens))


def test_piece_count_edges(documents):
    got = count_word_pieces(documents(EDGES, CLASHING), PATH).collect()
    assert len(got) == len(EDGES)
    counts = {(r.doc_id, r.n_words) for r in got}
    assert {(1, 0), (2, 0), (3, 0), (4, 1), (5, 7), (8, 1)} <= counts
    assert count_word_pieces(documents([]), PATH).count() == 0
