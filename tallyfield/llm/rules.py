"""Quality rules: counts over a text's words and lines, and a chain model that tells content from boilerplate.

Each line with a word is an observation of a linear-chain conditional random field with two labels. Viterbi
decoding marks the lines, and the share of words in content lines decides, after the plain rules, whether a text
is kept. The model is fitted on a bounded sample of labelled texts.

Words are runs of characters other than ASCII space; lines end at line breaks. Defined results: a null or empty
text has no words and is not kept; equal rows give equal rows; an empty table gives an empty table; other columns
are ignored. Without labelled texts of both kinds every line counts as content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, column_of, map_text, shingle_hashes, slices

#: Labelled texts used to fit, at most.
MAX_FIT = 2000
#: Texts whose content share is lower are not kept.
LEAST_CONTENT = 0.5
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

_SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros(256, np.uint8)
for _k, _members in enumerate((SPACES, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", _SYMBOLS, b"!", b"|"), 1):
    _CLASS[list(_members)] = _k
# a bar is both symbol and bar
_BAR = 7
_N_CLASSES = 8


@dataclass
class Described:
    """A text's counts and, for each line with a word, its features and number of words."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray
    line_words: np.ndarray


FEATURES = 14


def describe(text: bytes) -> Described:
    lines = text.split(b"\n")
    seen, repeated, own = set(), [], []
    for line in lines:
        if line.strip(SPACES):
            own.append(line)
            repeated.append(line in seen)
        seen.add(line)
    if not own:
        return Described(0, 0, 0, 0, 0, np.zeros((0, FEATURES)), np.zeros(0, np.int64))
    split = [line.split() for line in own]
    counts = np.array([len(w) for w in split])
    words = np.fromiter((hash(w) & 0xFFFFFFFFFFFFFFFF for line in split for w in line), np.uint64, counts.sum())
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    flat = np.frombuffer(b"".join(own), np.uint8)
    sizes = np.array([len(line) for line in own])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kinds = _CLASS[flat]
    line_of = np.repeat(np.arange(len(own)), sizes)
    table = np.bincount(line_of * _N_CLASSES + kinds, minlength=len(own) * _N_CLASSES).reshape(-1, _N_CLASSES)
    points = np.add.reduceat((flat & 0xC0) != 0x80, begin).astype(np.int64)
    spaces = table[:, 1]
    symbols = table[:, 5] + table[:, _BAR]
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    same[first] = 0
    chars = np.maximum(points - spaces, 1)
    letters = np.maximum(table[:, 2] + table[:, 3], 1)
    n = len(own)
    f = np.column_stack(
        [
            np.ones(n),
            np.log1p(counts),
            symbols / chars,
            table[:, 2] / letters,
            table[:, 6] / counts,
            table[:, _BAR] / counts,
            table[:, 4] / chars,
            [line.rstrip(SPACES).endswith(b".") for line in own],
            repeated,
            np.add.reduceat(same, first) / counts,
            chars / counts / 10,
            symbols > counts / 2,
            np.arange(n) == 0,
            np.arange(n) == n - 1,
        ]
    )
    # symbols are counted over the whole text; lines without a word hold none
    return Described(
        int(counts.sum()), int((points - spaces).sum()), int(symbols.sum()), sum(repeated), _repeats(words), f, counts
    )


def _repeats(words: np.ndarray, size: int = 5) -> int:
    """Words in windows of ``size`` words that occur twice or more in the text."""
    if len(words) < size + 1:
        return 0
    windows = shingle_hashes(words, size)
    _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.concatenate([[0], np.cumsum(counts[where.reshape(-1)] > 1)])
    at = np.arange(len(words))
    return int((twice[np.minimum(at + 1, len(windows))] > twice[np.maximum(at - size + 1, 0)]).sum())


@dataclass
class ChainModel:
    """Weights of a linear-chain conditional random field with labels 0 (boilerplate) and 1 (content)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    between: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights.T

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """Best sequence of labels; of equal ones, content."""
        own = self.scores(features).tolist()
        if not own:
            return np.zeros(0, np.int64)
        (a00, a01), (a10, a11) = self.between.tolist()
        back = []
        s0, s1 = own[0]
        for e0, e1 in own[1:]:
            to0, to1 = (s1 + a10 >= s0 + a00), (s1 + a11 >= s0 + a01)
            back.append((to0, to1))
            s0, s1 = e0 + (s1 + a10 if to0 else s0 + a00), e1 + (s1 + a11 if to1 else s0 + a01)
        label = int(s1 >= s0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])

    def content_share(self, d: Described) -> float:
        return float((self.viterbi(d.features) * d.line_words).sum() / d.n_words) if d.n_words else 0.0


def fit_chain(sequences: list[np.ndarray], labels: list[int]) -> ChainModel | None:
    """Maximise the ridge-penalised conditional likelihood; all lines of a text carry the text's label."""
    pairs = [(x, y) for x, y in zip(sequences, labels) if len(x)]
    if len({y for _, y in pairs}) < 2:
        return None
    every = np.concatenate([x for x, _ in pairs])
    mean, scale = every.mean(0), every.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    pairs.sort(key=lambda p: -len(p[0]))
    lengths = np.array([len(x) for x, _ in pairs])
    # lines of all texts by place: at place t the texts that have one are the first alive[t]
    places = int(lengths[0])
    alive = [(lengths > t).sum() for t in range(places)]
    x = [(np.stack([p[0][t] for p in pairs[:n]]) - mean) / scale for t, n in enumerate(alive)]
    y = np.array([p[1] for p in pairs])
    # each kind counts the same, however many lines it has
    weight = np.where(y == 1, 0.5 / lengths[y == 1].sum(), 0.5 / lengths[y == 0].sum())
    w, b = np.zeros((2, every.shape[1])), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, STEPS + 1):
        gw, gb = -RIDGE * w, -RIDGE * b
        own = [f @ w.T for f in x]
        forward = [own[0]]
        for t in range(1, places):
            n = alive[t]
            forward.append(own[t] + np.logaddexp(forward[-1][:n, :1] + b[0], forward[-1][:n, 1:] + b[1]))
        backward = [np.zeros((n, 2)) for n in alive]
        for t in range(places - 1, 0, -1):
            n = alive[t]
            after = own[t] + backward[t]
            backward[t - 1][:n] = np.logaddexp(after[:, :1] + b[:, 0], after[:, 1:] + b[:, 1])
        total = np.logaddexp(*(forward[0] + backward[0]).T)
        for t in range(places):
            n = alive[t]
            p = np.exp(forward[t] + backward[t] - total[:n, None])
            gw += (weight[:n, None] * (np.eye(2)[y[:n]] - p)).T @ x[t]
            if t:
                joint = np.exp(
                    forward[t - 1][:n, :, None] + b + (own[t] + backward[t])[:, None, :] - total[:n, None, None]
                )
                gb[0, 0] += weight[:n] @ ((y[:n] == 0) - joint[:, 0, 0])
                gb[0, 1] -= weight[:n] @ joint[:, 0, 1]
                gb[1, 0] -= weight[:n] @ joint[:, 1, 0]
                gb[1, 1] += weight[:n] @ ((y[:n] == 1) - joint[:, 1, 1])
        for i, (value, g) in enumerate(((w, gw), (b, gb))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            value += RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return ChainModel(mean, scale, w, b)


def fit_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_FIT
) -> ChainModel | None:
    """Fit on at most ``most`` texts with a label ``quality``, half of each kind, chosen by a hash of the id."""
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    chosen: dict = {}
    for q in (0, 1):
        some = marked.filter(F.col("quality") == q).orderBy(F.xxhash64(id_col), id_col).limit(most // 2)
        chosen |= {r[0]: q for r in some.collect()}
    wanted = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                rows = zip(column_of(part, id_col).to_pylist(), as_bytes(column_of(part, text_col)))
                found = [(wanted.value[i], describe(t).features) for i, t in rows if i in wanted.value]
                yield pa.RecordBatch.from_pydict(
                    {
                        "quality": pa.array([q for q, _ in found], pa.int32()),
                        "features": pa.array([x.astype("<f8").tobytes() for _, x in found], pa.binary()),
                    }
                )

    got = docs.select(id_col, text_col).mapInArrow(run, "quality int, features binary")
    rows = sorted((r[0], bytes(r[1])) for r in got.collect())
    return fit_chain([np.frombuffer(f, "<f8").reshape(-1, FEATURES) for _, f in rows], [q for q, _ in rows])


def judge(
    docs: DataFrame,
    model: ChainModel | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = LEAST_CONTENT,
) -> DataFrame:
    """Counts, content share and verdict for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part, texts):
        found = [describe(t) for t in texts]
        failed = [d.n_words < 10 or 100 * d.n_repeat_words > 20 * d.n_words for d in found]
        shares = [model.content_share(d) if model else float(d.n_words > 0) for d in found]
        return {
            id_col: column_of(part, id_col),
            **{c: [getattr(d, c) for d in found] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
            "base_failed": failed,
            "content_share": shares,
            "kept": [not f and s >= least for f, s in zip(failed, shares)],
        }

    return map_text(
        docs,
        text_col,
        f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, content_share double, kept boolean",
        work,
        id_col,
    )


def keep_good(docs: DataFrame, model: ChainModel | None, text_col: str = "text", least: float = LEAST_CONTENT) -> DataFrame:
    """The rows, with all columns, that the rules keep."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                found = [describe(t) for t in as_bytes(column_of(part, text_col))]
                kept = [
                    d.n_words >= 10
                    and 100 * d.n_repeat_words <= 20 * d.n_words
                    and (model is None or model.content_share(d) >= least)
                    for d in found
                ]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
