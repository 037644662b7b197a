"""Alignment of two tokenizers over the same bytes, by skipping along diagonals.

A text is cut into tokens twice; both cuts are arrays of byte positions where tokens end. Where one token of A
faces one token of B, the arrays run along a diagonal: position i of A equals position i + shift of B. Exponential
probing compares stretches of both arrays at the current shift, twice as long each time, then halves down to the
end of the run. An irregular group is resolved by walking the lesser side until both ends meet again, which gives
the new shift. Common ends cut the tokens into groups; the last tokens of a group, whose bytes end together, are
linked.

Links are counted by id pair over the whole table. Tasks deal their rows into chunks of bounded size, and a chunk
sends each of its pairs once, so a pair that is everywhere is one row a chunk; a row carries its links as numbers
within its chunk. The counts come back to the chunk by a join, never to the driver.

Defined results: a null or empty text, and one whose joined tokens of either tokenizer differ from the space and
the text, has no tokens, only zeros and an empty digest; equal rows give equal rows and count each; an empty table
gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import column_of, let_go, slices
from .varints import pack, unpack

#: Links and rows of a chunk (about; a longer text is not split).
CHUNK_LINKS, CHUNK_ROWS = 1 << 21, 1 << 15
#: Bytes of text aligned at a time: their tokens are lists of numbers for a while, some 30 times its size.
PART_BYTES = 256 << 10
#: Greater than any position.
BEYOND = 1 << 62
# Fixed value: how byte-level vocabularies split text before merging.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level vocabulary file: ids of whole texts, special strings being plain text, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary = told["model"]["vocab"]
        # printable bytes stand for themselves, the others for the characters from 256 up
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"] for t in told.get("added_tokens", ())}
        ranks = {bytes(map(byte_of.__getitem__, p)): i for p, i in vocabulary.items() if p not in special}
        self.size = max([*vocabulary.values(), *(t["id"] for t in told.get("added_tokens", ()))]) + 1
        self.bytes = [b""] * self.size
        for piece, i in ranks.items():
            self.bytes[i] = piece
        # merges by rank and merges by list are the same if the list is in order of the ids it makes
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
        splits = told["pre_tokenizer"]
        plain = splits["type"] == "ByteLevel" and splits.get("use_regex", True) and not splits["add_prefix_space"]
        if made != sorted(made) or not plain or told.get("normalizer"):
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids
        else:
            self.encode = tiktoken.Encoding("bytes", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces:
    """A piece model file: ids of whole texts and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        read = SentencePieceProcessor(model_file=path)
        self.size = read.get_piece_size()
        self.bytes = [
            bytes([int(p[3:5], 16)]) if read.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(read.id_to_piece, range(self.size)))
        ]
        self.encode_all = lambda texts: read.encode(texts, num_threads=1)


class Pair:
    """Two tokenizers with what the digest needs of their ids."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.a, self.b = ByteLevel(bytes_path), Pieces(pieces_path)
        self.width_a, self.width_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # an id inside its side of a group, then the same id at the end of the side
        self.names = [b"%d%c" % (i, c) for n, marks in ((self.a.size, b",|"), (self.b.size, b",;")) for i in range(n) for c in marks]

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both for every text; none where the joined bytes of one differ from the space and the text."""
        for text, b in zip(texts, self.b.encode_all(texts)):
            want = b" " + text.encode()
            a = self.a.encode(" " + text) if text else []
            same = a and b"".join(map(self.a.bytes.__getitem__, a)) == want == b"".join(map(self.b.bytes.__getitem__, b))
            yield (a, b) if same else ([], [])


@lru_cache(maxsize=2)
def tokenizer_pair(bytes_path: str, pieces_path: str) -> Pair:
    return Pair(bytes_path, pieces_path)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both arrays of ascending ends that are equal, in order.

    Runs on one diagonal are jumped by comparing stretches of 1, 2, 4, ... ends, and halved down at their end.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b, w = ends_a.tobytes(), ends_b.tobytes(), ends_a.itemsize
    n_a, n_b = len(a), len(b)
    a.append(BEYOND)
    b.append(BEYOND)
    begins_a, begins_b, lengths = [], [], []
    i = j = 0
    while True:
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        if x == BEYOND:
            break
        left, n, step = min(n_a - i, n_b - j), 1, 1
        p, q = (i + 1) * w, (j + 1) * w
        while n + step <= left and raw_a[p : p + step * w] == raw_b[q : q + step * w]:
            n += step
            p += step * w
            q += step * w
            step += step
        while step > 1:
            step >>= 1
            if n + step <= left and raw_a[p : p + step * w] == raw_b[q : q + step * w]:
                n += step
                p += step * w
                q += step * w
        begins_a.append(i)
        begins_b.append(j)
        lengths.append(n)
        i += n
        j += n
    length = np.array(lengths, np.int64)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(np.array(begins_a, np.int64), length) + within, np.repeat(np.array(begins_b, np.int64), length) + within


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in lists)])


def align(pair: Pair, texts: list[str]) -> tuple[list[tuple[int, int, int, str]], list[np.ndarray]]:
    """((tokens of A, tokens of B, groups, digest), links as A id times B's size plus B id) of every text."""
    lists = list(pair.tokens(texts))
    ids_a, ids_b = _flat([x for x, _ in lists]), _flat([y for _, y in lists])
    ends_a, ends_b = np.cumsum(pair.width_a[ids_a]), np.cumsum(pair.width_b[ids_b])
    kind = np.int32 if not len(ends_a) or ends_a[-1] < 1 << 31 else np.int64
    # every text ends in a common end, so one walk goes through all of them
    at_a, at_b = common_ends(ends_a.astype(kind), ends_b.astype(kind))
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[at_a], last_b[at_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # A's side of a group stands before B's
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.append(0, at_b + 1)[group_a]] = 2 * ids_a + last_a
    order[np.arange(len(ids_b)) + (at_a + 1)[group_b]] = 2 * (pair.a.size + ids_b) + last_b
    codes = ids_a[at_a] * pair.b.size + ids_b[at_b]
    n_a, n_b = (np.array([len(x[k]) for x in lists], np.int64) for k in (0, 1))
    to_token, to_group = np.cumsum(n_a + n_b), np.searchsorted(at_a, np.cumsum(n_a))
    rows, links, token, group = [], [], 0, 0
    for a, b, t, g in zip(n_a.tolist(), n_b.tolist(), to_token.tolist(), to_group.tolist()):
        text = b"".join(map(pair.names.__getitem__, order[token:t].tolist()))[:-1]
        rows.append((a, b, g - group, hashlib.sha256(text).hexdigest() if a else ""))
        links.append(codes[group:g])
        token, group = t, g
    return rows, links


class _Chunk:
    """Rows of a task until they fill a chunk: then their links are numbered within it.

    Links are counted as they come, part by part, and packed part by part, so only counts of a chunk are held at once.
    """

    def __init__(self):
        self.ids, self.rows, self.parts, self.count = [], [], [], 0

    def add(self, ids: pa.Array, rows: list, links: list[np.ndarray]) -> None:
        flat = np.concatenate([np.zeros(0, np.int64), *links])
        pairs, number, totals = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in links])
        own, times = np.unique(owner * max(1, len(pairs)) + number, return_counts=True)
        row, number = np.divmod(own, max(1, len(pairs)))
        ends = np.searchsorted(row, np.arange(len(rows) + 1))
        self.ids.append(ids)
        self.rows += rows
        self.parts.append((pairs, totals, ends, number.astype(np.int32), times.astype(np.int32)))
        self.count += len(flat)

    def full(self) -> bool:
        return self.count >= CHUNK_LINKS or len(self.rows) >= CHUNK_ROWS

    def batch(self, chunk: int, schema: pa.Schema) -> pa.RecordBatch:
        """One row for each row, its links packed as (gap, times), and one row of the chunk's pairs."""
        n = len(self.rows)
        pairs, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in self.parts)]), return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        packed, begin = [], 0
        for own, seen, ends, number, times in self.parts:
            at = place[begin : begin + len(own)]  # ascending, as the part's own pairs are
            begin += len(own)
            totals[at] += seen
            number = at[number]
            gaps = np.diff(number, prepend=0)
            first = ends[:-1][ends[:-1] < ends[1:]]
            gaps[first] = number[first]
            data, to = pack(np.stack([gaps, times], 1).ravel())
            cuts = np.append(0, to)[2 * ends].tolist()
            data = data.tobytes()
            packed += (data[x:y] for x, y in zip(cuts, cuts[1:]))
        counts = [[r[k] for r in self.rows] + [None] for k in range(4)]
        ids = pa.concat_arrays(self.ids).to_pylist() if self.ids else []
        columns = {
            "chunk": [chunk] * (n + 1),
            "id": [*ids, None],
            "n_a": counts[0],
            "n_b": counts[1],
            "n_groups": counts[2],
            "sha": counts[3],
            "links": [*packed, None],
            "pairs": pa.array([*[None] * n, pairs], pa.list_(pa.int64())),
            "totals": pa.array([*[None] * n, totals], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def chunks(pair: Pair, batches: Iterator[pa.RecordBatch], first: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's rows, numbered from ``first``; what the worker holds without use goes back at the end."""
    chunk = _Chunk()
    for batch in batches:
        for part in slices(batch, "text", size=PART_BYTES):
            texts = [t or "" for t in column_of(part, "text").to_pylist()]
            chunk.add(column_of(part, "id"), *align(pair, texts))
            if chunk.full():
                yield chunk.batch(first, schema)
                chunk, first = _Chunk(), first + 1
    if chunk.rows:
        yield chunk.batch(first, schema)
    del chunk
    let_go()


def align_tokenizers(df: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    ``n_best`` counts the links whose pair is the most frequent of its B id over the whole table, ties included;
    ``count_sum`` adds up how often the pairs of a row's links are linked over the whole table.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"chunk bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, sha string, links binary, pairs array<bigint>, totals array<bigint>"
    arrow = _arrow(df, id_col)

    def run(batches):
        yield from chunks(tokenizer_pair(bytes_path, pieces_path), batches, TaskContext.get().partitionId() << 32, arrow)

    aligned = cut_lineage(rows.mapInArrow(run, schema), "aligned")
    seen = aligned.filter("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "totals")).alias("pos", "link"))
    seen = seen.select("chunk", "pos", F.col("link.pairs").alias("pair"), F.col("link.totals").alias("n"))
    counted = seen.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.expr(f"pair % {_size(pieces_path)}"))  # at most one row for each id of A
    counted = counted.withColumn("best", (F.col("n") == F.max("n").over(of_b)).cast("int"))
    values = seen.drop("n").join(counted, "pair").select(F.col("chunk").alias("of"), "pos", "n", "best")
    out = (
        f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.argsort(right["pos"].to_numpy())
        n, best = right["n"].to_numpy()[at], right["best"].to_numpy()[at]
        sums, bests = [], []
        for raw in left["links"].to_pylist():
            gaps, times = unpack(np.frombuffer(raw, np.uint8)).reshape(-1, 2).T
            number = np.cumsum(gaps)
            sums.append(int((n[number] * times).sum()))
            bests.append(int((best[number] * times).sum()))
        let_go()
        groups = left["n_groups"]
        columns = [left["id"], left["n_a"], left["n_b"], groups, groups, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), left["sha"]]
        return pa.Table.from_arrays(columns, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    own = aligned.filter("pairs IS NULL").drop("pairs", "totals")
    return own.groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(settle, out)


def _size(pieces_path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces_path).get_piece_size()


def _arrow(df: DataFrame, id_col: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    longs = T.ArrayType(T.LongType())
    fields = [("chunk", T.LongType()), ("id", df.schema[id_col].dataType), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType())]
    fields += [("sha", T.StringType()), ("links", T.BinaryType()), ("pairs", longs), ("totals", longs)]
    return to_arrow_schema(T.StructType([T.StructField(n, t) for n, t in fields]))
