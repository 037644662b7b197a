"""Language-model scoring: prediction by partial matching over bytes, beside a plain word model.

The byte model is a trie of contexts of up to ``ORDER`` bytes, learned from all training rows. A byte is coded in
the longest context the trie knows; if it was not seen there, an escape leads to the next shorter context, where
the bytes of the longer one are excluded, down to equal shares of what is left. The escape's share of a context
is half its number of different bytes (method D), plus the occurrences of bytes that the trie does not keep. A
string's endings are at least as frequent, so the contexts are nested, and excluded counts are a number stored with
each context.

Scoring keeps every string of the training rows. A byte's share depends only on it and the ``ORDER`` bytes before it,
so every such code of the table gets its share once: codes are dealt by the last bytes of their context, which brings
together all longer strings that decide it, and strings of up to ``BASE + 1`` bytes are sent to all tasks. The shares
of the ``MAX_STRINGS`` most frequent codes are broadcast; all others are joined, counted by row. Logarithms are
rounded to 2^-32, so that sums do not depend on their order.

The coded text is the words in lower case (A-Z), joined by one space, and a line break as end. Words are runs of
characters other than ASCII space; the end counts as a token of the word model. Byte strings and words are counted
over all training rows. Words above a bounded number of frequent ones are joined, not broadcast.

Defined results: a null or empty text is its end alone; a null id is the empty text for the split; equal rows give
equal rows; without training rows every byte has the same share and no word is known; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_bytes, column_of, slices

ORDER = 5
MAX_STRINGS = 1 << 20
#: Bytes of the longest contexts that every task has; their strings are bounded by the number of bytes alone.
BASE = 2
ALL_BASE = 1 << 25
MAX_WORDS = 1 << 17
END = b"\n"
_LENGTH = 56  # bit at which a code holds the length of its string


def coded_text(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def held_out(ids: list) -> list[bool]:
    return [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in ids]


def _codes(coded: list[bytes], order: int) -> np.ndarray:
    """For every byte of the texts, it and the ``order`` bytes before it in one number; line breaks stand before a
    text's beginning."""
    lead = END * order
    flat = np.frombuffer(b"".join([x for t in coded for x in (lead, t)]), np.uint8).astype(np.int64)
    codes = np.zeros(len(flat), np.int64)
    for back in range(order, -1, -1):
        codes <<= 8
        codes[back:] |= flat[: len(flat) - back]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    ends = np.cumsum(lengths + order)
    real = np.ones(len(flat), bool)
    for k in range(order):
        real[ends - lengths - order + k] = False
    return codes[real]


def _sorted_counts(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


class CodeIndex:
    """Place of a code among given different ones, by open addressing."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(4, int(np.ceil(np.log2(max(len(codes), 1) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(codes), dtype=np.int32), self._slot(codes)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __reduce__(self):
        return CodeIndex, (self.codes,)

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self._slot(codes)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.codes[found] != codes)) if len(self.codes) else np.zeros(0, np.int64)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.codes[found[wrong]] != codes[wrong])]
        return found


@dataclass
class ByteModel:
    """Kept strings with counts; contexts with all occurrences, kept ones, different bytes and excluded counts."""

    order: int
    strings: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kept: np.ndarray
    kinds: np.ndarray
    excluded: np.ndarray

    def __post_init__(self):
        self.by_string, self.by_context = CodeIndex(self.strings), CodeIndex(self.contexts)

    def __reduce__(self):
        return ByteModel, (self.order, self.strings, self.counts, self.contexts, self.total, self.kept, self.kinds, self.excluded)

    def log_shares(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the share that each coded byte has after the bytes before it."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        longer = np.full(len(codes), -1, np.int32)
        for k in range(self.order, -1, -1):
            some = codes[left]
            here = self.by_context.find((some >> 8) & ((1 << 8 * k) - 1) | k << _LENGTH)
            known = np.flatnonzero(here >= 0)
            if not len(known):
                continue
            at, before, some = here[known], longer[known], some[known]
            cut = before >= 0
            total, kinds, kept = self.total[at], self.kinds[at], self.kept[at]
            total = total - np.where(cut, self.excluded[before], 0)
            kept = kept - np.where(cut, self.excluded[before], 0)
            kinds = kinds - np.where(cut, self.kinds[before], 0)
            string = self.by_string.find(some & ((1 << 8 * (k + 1)) - 1) | (k + 1) << _LENGTH)
            seen = string >= 0
            part = np.where(seen, self.counts[string] - 0.5, total - kept + 0.5 * kinds)
            # a context whose bytes are all excluded passes on without cost
            share = np.where(total > 0, part / np.maximum(total, 1), 1.0)
            out[left[known]] += np.log10(share)
            longer[known] = at
            going = np.ones(len(left), bool)
            going[known[seen]] = False
            left, longer = left[going], longer[going]
        root = self.by_context.find(np.array([0], np.int64))[0]
        out[left] -= np.log10(256 - (self.kinds[root] if root >= 0 else 0))
        return out


def build_model(order: int, strings: np.ndarray, counts: np.ndarray, contexts: np.ndarray, total: np.ndarray) -> ByteModel:
    """From kept strings (codes with length) and the occurrences of their contexts."""
    length = strings >> _LENGTH
    body = strings & ((1 << _LENGTH) - 1)
    index = CodeIndex(contexts)
    owner = index.find(body >> 8 | (length - 1) << _LENGTH)
    kinds = np.bincount(owner, minlength=len(contexts)).astype(np.int64)
    kept = np.bincount(owner, counts, minlength=len(contexts)).astype(np.int64)
    longer = np.flatnonzero(length > 1)
    shorter = CodeIndex(strings).find(
        body[longer] & ((np.int64(1) << 8 * (length[longer] - 1)) - 1) | (length[longer] - 1) << _LENGTH
    )
    excluded = np.bincount(owner[longer], counts[shorter], minlength=len(contexts)).astype(np.int64)
    return ByteModel(order, strings, counts, contexts, total, kept, kinds, excluded)


@dataclass
class Corpus:
    """Counts over the training rows: (code, n) of the longest byte strings and (word, n). Codes that only held-out
    rows have are there with 0."""

    codes: DataFrame
    words: DataFrame


def count_corpus(docs: DataFrame, id_col: str, text_col: str, order: int = ORDER) -> Corpus:
    """One pass over the training rows; each task counts its own rows before anything is shuffled."""

    def run(batches):
        words: Counter[bytes] = Counter()
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for part in slices(batch, text_col):
                out = held_out(column_of(part, id_col).to_pylist())
                split = [t.lower().split() for t, h in zip(as_bytes(column_of(part, text_col)), out) if not h]
                for w in split:
                    words.update(w)
                if split:
                    words[END] += len(split)
                codes, counts = _sorted_counts(_codes([coded_text(w) for w in split], order))
                tested = [t.lower().split() for t, h in zip(as_bytes(column_of(part, text_col)), out) if h]
                more = np.unique(_codes([coded_text(w) for w in tested], order))
                codes, counts = np.concatenate([codes, more]), np.concatenate([counts, np.zeros(len(more), np.int64)])
                held = _sorted_counts(np.concatenate([held[0], codes]), np.concatenate([held[1], counts])) if len(codes) else held
                if len(words) > 300_000:
                    yield from rows(words, None)
                    words.clear()
                if len(held[0]) > 1_500_000:
                    yield from rows(None, held)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield from rows(words, held)

    def rows(words, held):
        if words:
            items = iter(words.items())
            while some := list(islice(items, 1 << 15)):
                keys, counts = zip(*some)
                yield pa.RecordBatch.from_pydict(
                    {"word": pa.array(keys, pa.binary()), "code": pa.nulls(len(some), pa.int64()), "n": pa.array(counts, pa.int64())}
                )
        if held:
            for at in range(0, len(held[0]), 1 << 15):
                codes, counts = (x[at : at + (1 << 15)] for x in held)
                yield pa.RecordBatch.from_pydict(
                    {"word": pa.nulls(len(codes), pa.binary()), "code": pa.array(codes), "n": pa.array(counts)}
                )

    counted = docs.select(id_col, text_col).mapInArrow(run, "word binary, code bigint, n bigint")
    summed = cut_lineage(counted.groupBy("word", "code").agg(F.sum("n").alias("n")), "corpus")
    return Corpus(
        summed.filter("code is not null").select("code", "n"), summed.filter("word is not null").select("word", "n")
    )


def _least_count(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows reach, from a histogram in steps of an eighth of a doubling."""
    step = F.floor(F.log2("n") * 8).cast("int")
    groups = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    least, rows = None, 0
    for g in sorted(groups.collect(), key=lambda g: -g["step"]):
        rows += g["rows"]
        if rows > most:
            return g["high"] + 1 if least is None else least
        least = g["low"]
    return least or 1


def learn_bytes(corpus: Corpus, order: int = ORDER, most: int = MAX_STRINGS) -> ByteModel:
    """The trie of the most frequent strings of all lengths; what reaches the driver has at most ``most`` rows."""
    longest = corpus.codes.filter("n > 0")
    lengths = [
        longest.groupBy((F.col("code").bitwiseAND((1 << 8 * k) - 1)).alias("body"))
        .agg(F.sum("n").alias("n"))
        .select((F.col("body") + F.lit(k << _LENGTH)).alias("code"), "n")
        for k in range(1, order + 2)
    ]
    every = lengths[0]
    for some in lengths[1:]:
        every = every.union(some)
    every = cut_lineage(every, "strings")
    least = _least_count(every, most)
    kept = every.filter(F.col("n") >= least).toArrow()
    body, length = F.col("code").bitwiseAND((1 << _LENGTH) - 1), F.shiftright("code", _LENGTH)
    contexts = (
        every.groupBy((F.shiftright(body, 8) + F.shiftleft(length - 1, _LENGTH)).alias("context"))
        .agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
        .filter(F.col("largest") >= least)
        .select("context", "total")
        .toArrow()
    )
    take = lambda t, c: t.column(c).to_numpy().astype(np.int64)
    return build_model(order, take(kept, "code"), take(kept, "n"), take(contexts, "context"), take(contexts, "total"))


def _code_shares(codes: np.ndarray, counts: np.ndarray, order: int, base: ByteModel) -> np.ndarray:
    """log10 of the share of every code, given all codes whose contexts end in the same BASE + 1 bytes."""
    seen = counts > 0
    strings, amounts, contexts, totals = [base.strings], [base.counts], [base.contexts], [base.total]
    for k in range(base.order + 1, order + 1):
        body, n = codes[seen] & ((1 << 8 * (k + 1)) - 1), counts[seen]
        if not len(body):
            break
        body, n = _sorted_counts(body, n)
        strings.append(body | (k + 1) << _LENGTH)
        amounts.append(n)
        # bodies are sorted, so equal contexts are neighbours
        context, total = _sorted_counts(body >> 8, n)
        contexts.append(context | k << _LENGTH)
        totals.append(total)
    model = build_model(order, *(np.concatenate(x) for x in (strings, amounts, contexts, totals)))
    return np.round(model.log_shares(codes) * 2.0**32) / 2.0**32


def share_codes(corpus: Corpus, order: int) -> DataFrame:
    """(code, n, share): log10 of the share of every code of the table, from all strings of the training rows."""
    base = corpus.codes.sparkSession.sparkContext.broadcast(learn_bytes(corpus, min(BASE, order), ALL_BASE))

    def run(batches):
        held = [(column_of(b, "code").to_numpy(), column_of(b, "n").to_numpy()) for b in batches]
        if not held:
            return
        codes, counts = (np.concatenate(x).astype(np.int64) for x in zip(*held))
        shares = _code_shares(codes, counts, order, base.value)
        for at in range(0, len(codes), 1 << 15):
            some = slice(at, at + (1 << 15))
            yield pa.RecordBatch.from_pydict({"code": codes[some], "n": counts[some], "share": shares[some]})

    end = F.shiftright("code", 8).bitwiseAND((1 << 8 * (BASE + 1)) - 1)
    dealt = corpus.codes.repartition(end)
    return cut_lineage(dealt.mapInArrow(run, "code bigint, n bigint, share double"), "shares")


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    most_strings: int = MAX_STRINGS,
    most_words: int = MAX_WORDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    corpus = count_corpus(docs, id_col, text_col, order)
    shares = share_codes(corpus, order)
    common = _least_count(shares.filter("n > 0"), most_strings)
    sent = shares.filter(F.col("n") >= common).select("code", "share").toArrow()
    index = CodeIndex(sent.column("code").to_numpy().astype(np.int64))
    tokens, distinct = corpus.words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _least_count(corpus.words, most_words)
    frequent = corpus.words.filter(F.col("n") >= least).toArrow()
    known = dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist()))
    bottom = tokens + 0.5 * (distinct + 1)
    shared = spark.sparkContext.broadcast((index, sent.column("share").to_numpy(), known))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        index, logs_of, known = shared.value
        logs = {w: np.log10((n + 0.5) / bottom) for w, n in known.items()}
        for batch in batches:
            for part in slices(batch, text_col):
                ids = column_of(part, id_col)
                split = [t.lower().split() for t in as_bytes(column_of(part, text_col))]
                coded = [coded_text(w) for w in split]
                codes = _codes(coded, order)
                found = index.find(codes)
                missed = np.flatnonzero(found < 0)
                made = np.zeros(len(codes))
                made[found >= 0] = logs_of[found[found >= 0]]
                ends = np.cumsum([0, *map(len, coded)])
                begins = ends[:-1]
                # codes without a share here: each once in a row, with its occurrences
                far = [np.unique(c, return_counts=True) for c in np.split(codes[missed], np.searchsorted(missed, ends[1:-1]))]
                base, hits, rare = [], [], []
                for words in split:
                    words.append(END)
                    got = [logs[w] for w in words if w in logs]
                    base.append(float(sum(got)))
                    hits.append(len(got))
                    rare.append([w for w in words if w not in logs] if len(got) < len(words) else [])
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": ids,
                        "held_out": pa.array(held_out(ids.to_pylist()), pa.bool_()),
                        "n_tokens": pa.array([len(w) for w in split], pa.int64()),
                        "hits": pa.array(hits, pa.int64()),
                        "base": pa.array(base, pa.float64()),
                        "score": pa.array(np.add.reduceat(made, begins), pa.float64()),
                        "far": pa.array([c for c, _ in far], pa.list_(pa.int64())),
                        "far_times": pa.array([t for _, t in far], pa.list_(pa.int64())),
                        "rare": pa.array(rare, pa.list_(pa.binary())),
                    }
                )

    scored = docs.select(id_col, text_col).mapInArrow(
        run,
        f"id {kind}, held_out boolean, n_tokens bigint, hits bigint, base double, score double, far array<bigint>, "
        "far_times array<bigint>, rare array<binary>",
    )
    scored = cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words that are not among the frequent ones: every row's are looked up by a join
    asked = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    met = asked.join(corpus.words.filter(F.col("n") < least), "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("logs")
    )
    # and so are codes; every code of the table has a share
    called = scored.select("row", F.explode(F.arrays_zip("far", "far_times")).alias("x")).select("row", "x.far", "x.far_times")
    rest = called.join(shares.filter(F.col("n") < common), called["far"] == shares["code"]).groupBy("row").agg(
        F.sum(F.col("far_times") * F.col("share")).alias("far_score")
    )
    unknown = F.col("n_tokens") - F.col("hits") - F.coalesce("more", F.lit(0))
    low = float(np.log10(bottom))
    return scored.drop("rare", "far", "far_times").join(met, "row", "left").join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("bigint").alias("train_tokens"),
        (
            F.col("base")
            + F.coalesce("logs", F.lit(0.0))
            - F.coalesce("more", F.lit(0)) * F.lit(low)
            + unknown * F.lit(float(np.log10(0.5)) - low)
        ).alias("base_score"),
        (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"),
    )
