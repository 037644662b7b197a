"""SentencePiece encoding by a table of last tokens, and decoding.

In a byte-pair encoding every prefix of a text has one encoding, so one last token. The table holds it for each
prefix: among the vocabulary entries that end there (found by an automaton over all entries), the one whose
left neighbour, the last token of the shorter prefix, is compatible with it. Two tokens are compatible if no
merge across their border would come before the merges inside them. The ids are read from the table backwards.

Entries hold the space mark only at their beginning and no line break, so a text is encoded in units that end
before a space mark or a line break. The distinct units of a slice of rows are encoded together, one character
position after another in all of them: the automaton is one array of transitions over the commonest characters, and
the tokens that end in a state are tried from the longest. Tests of pairs of tokens are kept in a table of fixed size.
A worker keeps nothing beyond its task. Long units and units with other characters are encoded one by one by the same table
and a searched automaton; characters without an entry become their bytes. Nothing is cut or left out.

Defined results: a null or empty text has no ids and decodes to the empty text; equal rows give equal rows; an
empty table gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_of, map_text

MARK = "▁"
#: Characters with transitions of their own, the longest unit encoded along with others, and slots for tested pairs.
LETTERS, LONGEST, SLOTS = 254, 64, 1 << 20
ALIKE = -1
_UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


class PieceModel:
    """Vocabulary, derivations and the automaton of a byte-pair model file with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        read = SentencePieceProcessor(model_file=path)
        self.size = size = read.get_piece_size()
        self.pieces = [read.id_to_piece(i) for i in range(size)]
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i in range(size) if read.is_byte(i)}
        if len(self.bytes_at) != 256:
            raise ValueError("the model has no byte fallback")
        special = {i for i in range(size) if read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("an entry holds a space mark after another character")
        if any("\n" in p for p in self.ids):
            raise ValueError("an entry holds a line break")
        # merges go from the highest score down
        self.rank = [-read.get_score(i) for i in range(size)]
        self.table = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.bytes_at.items():
            self.table[i] = bytes([b])
        for i in range(size):
            if read.is_control(i):
                self.table[i] = b""
            elif read.is_unknown(i):
                self.table[i] = " ⁇ ".encode()
        self.children: dict[int, tuple[int, int]] = {}
        self.whole: set[int] = set()
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            self._derive(p, i)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if i in self.whole:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        self.tested = np.full(SLOTS, -1, np.int32 if size * size < 1 << 31 else np.int64)
        self.passed = np.zeros(SLOTS, bool)
        self._transitions()

    def _transitions(self) -> None:
        """The automaton over the commonest characters as one array, and the tokens that end in each state."""
        often = Counter(c for p, i in self.ids.items() if i in self.whole and len(p) > 1 for c in p)
        letters = sorted(c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
        # characters that no longer entry holds are all alike: each is its own token after any other
        single = [c for c in self.known if c not in often]
        self.letter = np.zeros(0x110000, np.uint8)
        self.letter[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.letter[[ord(c) for c in single]] = 1
        self.token_of = np.zeros(0x110000, np.uint16 if self.size <= 1 << 16 else np.int32)
        self.token_of[[ord(c) for c in self.known]] = [self.ids[c] for c in self.known]
        code = {c: k + 2 for k, c in enumerate(letters)}
        child, ends, fail = [{}], [[]], [0]
        if single:
            child, ends, fail = [{1: 1}, {}], [[], [ALIKE]], [0, 0]
        for p, i in self.ids.items():
            if i in self.whole and all(c in code for c in p):
                node = 0
                for c in p:
                    if code[c] not in child[node]:
                        child[node][code[c]] = len(child)
                        child.append({})
                        ends.append([])
                        fail.append(0)
                    node = child[node][code[c]]
                ends[node].append(i)
        self.next = np.zeros((len(child), len(letters) + 2), np.uint16 if len(child) <= 1 << 16 else np.int32)
        level = [0]
        while level:
            below = []
            for node in level:
                back = self.next[fail[node]]
                row = back.copy() if node else np.zeros_like(back)
                ends[node] = ends[node] + ends[fail[node]] if node else []
                for c, v in child[node].items():
                    fail[v] = int(back[c]) if node else 0
                    row[c] = v
                    below.append(v)
                self.next[node] = row
            level = below
        counts = np.array([len(e) for e in ends])
        self.out_from = np.cumsum(counts) - counts
        self.out = np.array([*chain.from_iterable(ends), 0], np.int64)
        self.length = np.array([len(p) for p in self.pieces], np.int64)

    def _derive(self, piece: str, token: int) -> None:
        """The last merge that makes an entry from its characters, if merging its characters ends in it."""
        if any(c not in self.ids for c in piece):
            return
        parts = [self.ids[c] for c in piece]
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                made = self.ids.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])
                if made is not None and (best is None or self.rank[made] < best[0]):
                    best = (self.rank[made], k, made)
            if best is None:
                return
            _, k, made = best
            if made == token:
                self.children[token] = (parts[k], parts[k + 1])
                if self.rank[token] < max(self._made(parts[k]), self._made(parts[k + 1])):
                    raise ValueError(f"entry {piece} comes before its parts")
            parts[k : k + 2] = [made]
        self.whole.add(token)

    def _made(self, token: int) -> float:
        """When a token comes into being: single characters are there from the start."""
        return self.rank[token] if len(self.pieces[token]) > 1 else float("-inf")

    def _spine(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """(token, made, merged) along one edge of its derivation."""
        out, merged = [], float("inf")
        while True:
            out.append((token, self._made(token), merged))
            if token not in self.children:
                return out
            merged = self.rank[token]
            token = self.children[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text of two tokens is encoded as these two; of equal merges the left one comes first."""
        left = self._spine(b, 0)
        for x, made_x, merged_x in self._spine(a, 1):
            for y, made_y, merged_y in left:
                if made_x <= merged_y and made_y < merged_x:
                    both = self.ids.get(self.pieces[x] + self.pieces[y])
                    if both is not None and self.rank[both] < merged_x and self.rank[both] <= merged_y:
                        return False
        return True

    def compatible_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As :meth:`compatible` for many pairs; each is tested once as long as its slot is not taken by another."""
        key = a * self.size + b
        slot = (key * 0x9E3779B1 >> 12) % SLOTS
        out = self.passed[slot]
        missed = np.flatnonzero(self.tested[slot] != key)
        if len(missed):
            fresh, at = np.unique(key[missed], return_inverse=True)
            passed = np.fromiter((self.compatible(*divmod(k, self.size)) for k in fresh.tolist()), bool, len(fresh))
            out[missed] = passed[at]
            slot = (fresh * 0x9E3779B1 >> 12) % SLOTS
            # of pairs that share a slot both arrays must keep the same one
            slot, last = np.unique(slot, return_index=True)
            self.tested[slot], self.passed[slot] = fresh[last], passed[last]
        return out

    def encode_run(self, run: str) -> list[int]:
        """Ids of characters that all have an entry."""
        last: list[tuple[int, int]] = [(-1, 0)] + [(-1, -1)] * len(run)
        for end, (token, length) in self.automaton.iter(run):
            end += 1
            begin = end - length
            if last[end][1] < 0 and (begin == 0 or last[begin][1] >= 0 and self.compatible(last[begin][0], token)):
                last[end] = (token, begin)
        ids, at = [], len(run)
        while at:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        if self.known.issuperset(unit):
            return tuple(self.encode_run(unit))
        ids, run = [], []
        for c in unit:
            if c in self.known:
                run.append(c)
                continue
            if run:
                ids += self.encode_run("".join(run))
                run = []
            ids += [self.bytes_at[b] for b in c.encode()]
        if run:
            ids += self.encode_run("".join(run))
        return tuple(ids)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them) of all units, one after another."""
        sizes = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        codes = self.letter[points]
        begins = np.cumsum(sizes) - sizes
        strange = np.zeros(len(units), bool)
        if len(codes):
            strange[np.searchsorted(begins, np.flatnonzero(codes == 0), "right") - 1] = True
        alone = strange | (sizes > LONGEST)
        # the longest first, so that those still active stand at the beginning
        together = np.flatnonzero(~alone)
        together = together[np.argsort(-sizes[together], kind="stable")]
        ids, counts = self._last_tokens(points, codes, begins[together], sizes[together])
        total = np.zeros(len(units), np.int64)
        total[together] = counts
        others = {int(u): self.encode_unit(units[u]) for u in np.flatnonzero(alone)}
        for u, own in others.items():
            total[u] = len(own)
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[_spans(ends[together] - counts, counts)] = ids
        for u, own in others.items():
            out[ends[u] - len(own) : ends[u]] = own
        return out, total

    def _last_tokens(self, points: np.ndarray, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them) of units in order of falling size, from the table of their prefixes' last tokens."""
        n, longest = len(sizes), int(sizes.max(initial=0))
        last = np.zeros((longest + 1, n), np.int32)
        state = np.zeros(n, self.next.dtype)
        active = np.searchsorted(-sizes, -np.arange(longest + 1), "right")
        for end in range(1, longest + 1):
            k = active[end]
            state[:k] = self.next[state[:k], codes[begins[:k] + end - 1]]
            at, tried = np.arange(k), self.out_from[state[:k]]
            while len(at):
                token = self.out[tried]
                alike = np.flatnonzero(token == ALIKE)
                token[alike] = self.token_of[points[begins[at[alike]] + end - 1]]
                left = end - self.length[token]
                fits = left == 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.compatible_pairs(last[left[inner], at[inner]].astype(np.int64), token[inner])
                last[end, at[fits]] = token[fits]
                at, tried = at[~fits], tried[~fits] + 1
        # read backwards
        found, owner, where, at = [], [], sizes.copy(), np.arange(n)
        while len(at):
            token = last[where[at], at]
            found.append(token)
            owner.append(at)
            where[at] -= self.length[token]
            at = at[where[at] > 0]
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        owner, steps = np.concatenate(owner), np.repeat(np.arange(len(found)), [len(f) for f in found])
        counts = np.bincount(owner, minlength=n)
        ids = np.empty(len(owner), np.int32)
        ids[np.cumsum(counts)[owner] - 1 - steps] = np.concatenate(found)
        return ids, counts

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; the units that they share are encoded once."""
        split = [_UNITS.findall(MARK + t.replace(" ", MARK)) if t else () for t in texts]
        units = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        ids, counts = self.encode_units(units.dictionary.to_pylist())
        which = units.indices.to_numpy()
        sizes = counts[which]
        flat = ids[_spans((np.cumsum(counts) - counts)[which], sizes)]
        cuts = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, split)])]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        data = b"".join(map(self.table.__getitem__, ids))
        if len(ids) and self.table[ids[0]].startswith(b" ") and self.pieces[ids[0]].startswith(MARK):
            data = data[1:]
        return data.decode("utf-8", "each_byte")


def _spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs with the given beginnings and sizes, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id, ids, decoded) for every row: token ids of the whole text and, if asked, the text decoded from them."""

    def work(part, texts):
        m = piece_model(model)
        encoded = m.encode_all([t.decode("utf-8", "replace") for t in texts])
        offsets = np.zeros(len(encoded) + 1, np.int32)
        np.cumsum([len(x) for x in encoded], out=offsets[1:])
        values = np.concatenate([np.zeros(0, np.int32), *encoded])
        columns = {
            id_col: column_of(part, id_col),
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
        }
        return columns | {"decoded": [m.decode(x.tolist()) for x in encoded]} if decode else columns

    kind = df.schema[id_col].dataType.simpleString()
    return map_text(df, text_col, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decode, work, id_col, after=piece_model.cache_clear)


def decode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) for rows of token ids; null ids give the empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        m = piece_model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [m.decode(x or []) for x in column_of(part, ids_col).to_pylist()]
                yield pa.RecordBatch.from_pydict({id_col: column_of(part, id_col), "decoded": pa.array(texts, pa.string())})

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
