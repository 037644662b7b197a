"""Word-piece lengths by linear longest-match: how many pieces greedy longest-match-first would cut words into.

A trie holds the vocabulary twice, words' beginnings below one root and continuations below another. When a
character has no child, the failure link of the node leads to where the match goes on, and the node's
precomputed number of popped pieces is added; so every character is read once and no piece is built.

Defined results: a null or empty text has no words; a word that cannot be cut counts as one unknown piece; equal
rows give equal rows; an empty table gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import column_of, map_text
from .pieces import MARK

#: Words whose piece counts a worker remembers.
REMEMBERED, LONGEST = 500_000, 64
NONE = -1


class PieceTrie:
    def __init__(self, begins, continues):
        """``begins``: entries that start a word; ``continues``: entries that follow another piece."""
        self.child: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, entries in ((0, begins), (1, continues)):
            for entry in entries:
                node = root
                for c in entry:
                    nexts = self.child[node]
                    if c not in nexts:
                        nexts[c] = len(self.child)
                        self.child.append({})
                        ends.append(False)
                    node = nexts[c]
                if entry:
                    ends[node] = True
        self.fail = [NONE] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, v in self.child[node].items():
                    below.append(v)
                    if ends[v]:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    at, count = self.fail[node], self.popped[node]
                    while at != NONE and c not in self.child[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at != NONE:
                        self.fail[v], self.popped[v] = self.child[at][c], count
            level = below
        self.remembered: dict[bytes, int] = {}

    def pieces(self, word: str) -> int:
        """Number of pieces, 0 if the word cannot be cut."""
        child, fail, popped = self.child, self.fail, self.popped
        node = count = 0
        for c in word:
            while c not in child[node]:
                if fail[node] == NONE:
                    return 0
                count += popped[node]
                node = fail[node]
            node = child[node][c]
        while node > 1:
            if fail[node] == NONE:
                return 0
            count += popped[node]
            node = fail[node]
        return count

    def count(self, words: list[bytes]) -> tuple[int, int]:
        """(pieces, unknown words) of a text's words."""
        known, total, unknown = self.remembered, 0, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.pieces(w.decode("utf-8", "replace"))
                if len(w) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = n
            if n:
                total += n
            else:
                unknown += 1
        return total + unknown, unknown


@lru_cache(maxsize=2)
def model_trie(path: str) -> PieceTrie:
    """Trie of a piece model: entries with the space mark begin words, the others continue them."""
    from sentencepiece import SentencePieceProcessor

    read = SentencePieceProcessor(model_file=path)
    plain = [
        read.id_to_piece(i)
        for i in range(read.get_piece_size())
        if not (read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i))
    ]
    return PieceTrie(
        [p[1:] for p in plain if p.startswith(MARK) and MARK not in p[1:]], [p for p in plain if MARK not in p]
    )


def count_word_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_pieces, n_unknown) for every row; words are runs of characters other than ASCII space."""

    def work(part, texts):
        trie = model_trie(model)
        split = [t.split() for t in texts]
        counts = [trie.count(w) for w in split]
        return {
            id_col: column_of(part, id_col),
            "n_words": [len(w) for w in split],
            "n_pieces": [c[0] for c in counts],
            "n_unknown": [c[1] for c in counts],
        }

    kind = df.schema[id_col].dataType.simpleString()
    return map_text(df, text_col, f"`{id_col}` {kind}, n_words bigint, n_pieces bigint, n_unknown bigint", work, id_col)
