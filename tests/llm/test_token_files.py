import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyfield.llm.token_files import BATCH, TokenFile, UnitEncoder, _Writer, token_checksums, units_by_bytes, write_token_files

from .conftest import CLASHING, EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def encode(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    draw = random.Random(4)
    parts = ["the", " the", "'s", "'ll", " 12", "3", "é", "日本", "😀", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x85", "\x1c", "!!", "_", "½", "²", " ", "don't", "<|endoftext|>", "ß", "　"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(4000)] + ["x" * 500, "ab" * 300]
    encoder = UnitEncoder(PATH)
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        assert [x.tolist() for x in encoder.encode(some)] == [encode(t) for t in some]


def test_the_model_is_asked_for_letters_and_gives_the_same_ids():
    draw = random.Random(8)
    letters = "abcdehiorstnABC" + "éèüßñÀÿıŁž"
    texts = [" ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 12))) + draw.choice(["", ".", ",", "!"]) for _ in range(9)) for _ in range(600)]
    encoder = UnitEncoder(PATH)
    assert encoder.model is not None
    assert [x.tolist() for x in encoder.encode(texts)] == [encode(t) for t in texts]


def test_units_told_by_bytes_give_the_ids_of_the_library():
    draw = random.Random(5)
    parts = [*"abzAZ019 \t\n\r\x0b'.,;:!?|)(_-#\x1c\x7f\x00", "'s", "'LL", "don't", " the", "é", "日", "”,", "é.", "e\u0301", "½", "😀", "  ", "\n "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 16))) for _ in range(6000)]
    units, counts = units_by_bytes(texts)
    cut = iter(units.to_pylist())
    assert ["".join(next(cut) for _ in range(n)) for n in counts] == texts and next(cut, None) is None
    encoder = UnitEncoder(PATH)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert [x.tolist() for x in encoder.encode(["", *some, ""])] == [[], *map(encode, some), []]
    assert units_by_bytes(["a 12,b  c"])[0].to_pylist() == ["a", " 12", ",b", " ", " c"]


def test_a_distinct_unit_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    encoder = UnitEncoder(PATH)
    encoder.known = Counted()
    texts = ["the same words, the same words. " * 20] * 50
    assert [x.tolist() for x in encoder.encode(texts)] == [encode(t) for t in texts]
    # with and without a space, a mark alone and the space at the end
    assert Counted.asked <= 10 and set(encoder.known) == {"the", " the", " same", " words", ",", ".", " "}


def test_another_pattern_encodes_whole_texts(tmp_path):
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    other.save(str(tmp_path / "other.json"))
    texts = ["the end of the day, and so on", "in the", ""]
    got = [x.tolist() for x in UnitEncoder(str(tmp_path / "other.json")).encode(texts)]
    assert got == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_units_is_bounded(monkeypatch):
    from tallyfield.llm import token_files

    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    encoder = UnitEncoder(PATH)
    for k in range(20):
        texts = [" ".join(f"w{k}x{i}" for i in range(30)), "again the same words"]
        assert [x.tolist() for x in encoder.encode(texts)] == [encode(t) for t in texts]
        assert len(encoder.known) < 120


def test_sequences_and_masks(tmp_path):
    path = str(tmp_path / "a.arrow")
    writer = _Writer(path, np.dtype("<u2"), 4)
    draw = np.random.default_rng(0)
    parts = [draw.integers(0, 60_000, n).astype("<u2") for n in (3, 0, 9, 4 * BATCH * 2 + 1, 6)]
    begins = [writer.add(p) for p in parts]
    writer.close()
    flat, file = np.concatenate(parts), TokenFile(path)
    for begin, part in zip(begins, parts):
        assert (file.run(begin, len(part)) == part).all()
    for i in range(-(-len(flat) // 4)):
        ids, mask = file.sequence(i)
        want = flat[4 * i : 4 * i + 4]
        assert (ids[: len(want)] == want).all() and mask.tolist() == [True] * len(want) + [False] * (4 - len(want))
    assert pa.types.is_fixed_size_list(file.file.schema.field("ids").type)
    ids, _ = file.sequence(1)
    assert ids.base is not None and not ids.flags.owndata


def test_rows_read_back(documents):
    rows = [*EDGES, *((100 - k, f"text number {k} " * k) for k in range(60))]
    docs = documents(rows, CLASHING).repartition(5)
    got = token_checksums(write_token_files(docs, PATH, length=16, file_bytes=2000)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = [*encode(t), 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_no_rows(documents):
    assert token_checksums(write_token_files(documents([]), PATH)).count() == 0
