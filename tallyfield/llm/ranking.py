"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

The index is made where the rows lie: a task folds its texts into shards of bounded size, and a shard holds, for
each of its terms, blocks of postings (gap, times) packed as bytes, with the last row and the greatest impact of
each block. Lengths, and so impacts, need the number of documents and terms of the whole table, which a first
pass counts.

A search sends the terms of a block of items to the shards that hold them. In a shard, lists are taken in order
of their greatest score; as soon as those left cannot together reach the score of the best rows so far, they are
non-essential: no new row can come from them, and they only complete the scores of rows found before. The greatest
impact of the block in which such a row would stand rejects it before the block is unpacked. Shards return their
best rows, which are merged.

Scores are whole numbers, and a row is left out only if it scores less than the worst of the best rows, so the
result is exact, ties included.

Defined results: a null text, or one without terms, is found by no item and counts for no statistic; an item
without terms finds nothing; items and rows that share an id are items and rows of their own; of equal scores the
lower id comes first, null before all others; empty tables give an empty table; columns other than the named ones
are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .common import as_bytes, column_of, let_go, map_text, slices
from .varints import pack, unpack

#: Bytes of text a shard (about; a longer text is not split), postings a block, items searched for together.
SHARD_BYTES, BLOCK, ITEMS = 8 << 20, 128, 1024
#: Bytes of terms and their uses that are sent to every task; more are joined through a shuffle.
SENT_BYTES = 8 << 20
#: Bytes of terms lie between these; A-Z become a-z. All bytes above ASCII are parts of terms.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def impact(times: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What one unit of a term's weight scores in a row that holds it ``times`` times."""
    return 10**9 * times // (1000 * times + 12 * length)


@dataclass
class Index:
    """Numbers of documents and terms, and the shards.

    A row of ``shards`` is one term of a shard, or, with a null term, the ids and lengths of the shard's rows.
    """

    documents: int
    terms: int
    shards: DataFrame


def count_terms(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows with a term, terms) of the whole table."""

    def work(part, texts):
        sizes = [len(terms(t)) for t in texts]
        return {"documents": [sum(map(bool, sizes))] + [0] * (len(sizes) - 1), "terms": [sum(sizes)] + [0] * (len(sizes) - 1)}

    counted = map_text(df, text_col, "documents bigint, terms bigint", work)
    total = counted.agg(F.sum("documents"), F.sum("terms")).first()
    return total[0] or 0, total[1] or 0


class _Shard:
    def __init__(self):
        self.ids, self.words, self.bytes = [], [], 0

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        self.ids.append(ids)
        self.words += map(terms, texts)
        self.bytes += sum(map(len, texts))

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.words) >= SHARD_BYTES >> 6

    def batches(self, shard: int, documents: int, total: int, schema: pa.Schema):
        """The row of ids and lengths, then one row a term."""
        n = len(self.words)
        sizes = [len(w) for w in self.words]
        # Python's numbers do not overflow where these products would
        length = np.array([75 + 25 * s * documents // max(1, total) for s in sizes], np.int64)
        ids = pa.concat_arrays(self.ids)
        row = {"shard": [shard], "term": [None], "rows": [n], "data": [None], "lengths": [length]}
        row |= {"ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)}
        yield self._batch(row | {c: [None] for c in ("tops", "lasts", "ends")}, schema)
        words = pa.array(chain.from_iterable(self.words), pa.binary()).dictionary_encode()
        if not len(words):
            return
        key = words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes)
        key, times = np.unique(key, return_counts=True)
        term, at = np.divmod(key, n)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        held = np.diff(np.append(first, len(term)))
        place = np.arange(len(term)) - np.repeat(first, held)
        begins = np.flatnonzero(place % BLOCK == 0)
        tops = np.maximum.reduceat(impact(times, length[at]), begins)
        lasts = at[np.append(begins[1:], len(at)) - 1]
        gaps = np.diff(at, prepend=0)
        gaps[begins] = at[begins]
        data, ends = pack(np.stack([gaps, times], 1).ravel())
        ends = ends[2 * np.append(begins[1:], len(at)) - 1]
        blocks = np.append(0, np.cumsum(-(-held // BLOCK))).astype(np.int32)
        cuts = np.append(0, ends[blocks[1:] - 1]).astype(np.int32)
        ends = ends - np.repeat(cuts[:-1], np.diff(blocks))

        def lists(values):
            return pa.ListArray.from_arrays(pa.array(blocks), pa.array(values.astype(np.int32)))

        m = len(first)
        raw = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
        columns = {"shard": [shard] * m, "term": words.dictionary, "rows": held, "data": raw, "ids": [None] * m, "lengths": [None] * m}
        yield self._batch(columns | {"tops": lists(tops), "lasts": lists(lasts), "ends": lists(ends)}, schema)

    @staticmethod
    def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
        arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of all terms of all rows, written to the shared folder. The texts are not shuffled."""
    documents, total = count_terms(df, text_col)
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    kind = df.schema[id_col].dataType
    fields = [("shard", T.LongType()), ("term", T.BinaryType()), ("rows", T.IntegerType()), ("tops", ints), ("lasts", ints), ("ends", ints)]
    fields += [("data", T.BinaryType()), ("ids", T.ArrayType(kind)), ("lengths", longs)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in batches:
            for part in slices(batch, "text"):
                shard.add(column_of(part, "id"), as_bytes(column_of(part, "text")))
                if shard.full():
                    yield from shard.batches(number, documents, total, arrow)
                    shard, number = _Shard(), number + 1
        if shard.words:
            yield from shard.batches(number, documents, total, arrow)
        let_go()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return Index(documents, total, cut_lineage(rows.mapInArrow(run, schema), "index"))


class Postings:
    """One term's list in a shard."""

    def __init__(self, tops: np.ndarray, lasts: np.ndarray, ends: np.ndarray, data: bytes):
        self.tops, self.lasts, self.data = tops, lasts, np.frombuffer(data, np.uint8)
        self.cuts = np.append(0, ends)
        self.top = int(tops.max())
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def read(self, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, times) of the named blocks, ascending, or of all; a list read whole is kept."""
        if self.whole is not None:
            return self.whole
        if blocks is None or 2 * len(blocks) >= len(self.tops):
            blocks = np.arange(len(self.tops))
        parts = [unpack(self.data[self.cuts[b] : self.cuts[b + 1]]).reshape(-1, 2) for b in blocks.tolist()] if len(blocks) < 8 else None
        if parts is None:
            taken = np.zeros(len(self.data), bool)
            for b in blocks.tolist():
                taken[self.cuts[b] : self.cuts[b + 1]] = True
            flat = unpack(self.data[taken]).reshape(-1, 2)
            per = BLOCK
            parts = [flat[k : k + per] for k in range(0, len(flat), per)]
        rows = np.concatenate([np.cumsum(p[:, 0]) for p in parts])
        times = np.concatenate([p[:, 1] for p in parts])
        if len(blocks) == len(self.tops):
            self.whole = rows, times
        return rows, times


def best_rows(lists: list[tuple[int, Postings]], lengths: np.ndarray, places: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the ``top`` best of a shard; of equal scores the lower ``places`` come first.

    ``lists`` holds the weight of each term, repeats included, and its postings.
    """
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].top)
    below = [0]
    for w, p in lists:
        below.append(below[-1] + w * p.top)
    scores = np.zeros(len(lengths), np.int64)
    least, k = 1, len(lists)
    # essential lists: until those left cannot reach the least score that counts
    while k and below[k] >= least:
        k -= 1
        w, p = lists[k]
        rows, times = p.read()
        scores[rows] += w * impact(times, lengths[rows])
        if len(scores) > top:
            least = max(least, int(np.partition(scores, -top)[-top]))
    found = np.flatnonzero(scores + below[k] >= least) if k else np.flatnonzero(scores >= least)
    found = found[scores[found] > 0]
    for k in range(k - 1, -1, -1):
        w, p = lists[k]
        block = np.searchsorted(p.lasts, found)
        inside = block < len(p.lasts)
        most = scores[found] + below[k]
        most[inside] += w * p.tops[block[inside]].astype(np.int64)
        # the block's greatest impact decides before the block is unpacked
        stays = most >= least
        found, block = found[stays], block[stays]
        blocks = np.unique(block[block < len(p.lasts)])
        if len(blocks):
            rows, times = p.read(blocks)
            at = np.searchsorted(rows, found)
            at[at == len(rows)] = 0
            hit = rows[at] == found
            scores[found[hit]] += w * impact(times[at[hit]], lengths[found[hit]])
            if len(found) > top:
                least = max(least, int(np.partition(scores[found], -top)[-top]))
    found = found[scores[found] >= least]
    order = np.lexsort((places[found], -scores[found]))[:top]
    return found[order], scores[found[order]]


def search(
    index: Index,
    items: DataFrame,
    top: int = 20,
    item_id: str = "item_id",
    item_text: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """(item id, rank, id, score) of the ``top`` best rows of every item, by all its terms, repeats included."""
    id_kind = index.shards.schema["ids"].dataType.elementType
    item_kind = items.schema[item_id].dataType.simpleString()
    named = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    named = cut_lineage(named.withColumn("number", F.monotonically_increasing_id()), "items")

    def split(part, texts):
        counts = [Counter(terms(t)) for t in texts]
        numbers = column_of(part, "number").to_pylist()
        return {
            "number": [i for i, c in zip(numbers, counts) for _ in c],
            "term": [t for c in counts for t in c],
            "times": [n for c in counts for n in c.values()],
        }

    asked = cut_lineage(map_text(named, "text", "number bigint, term binary, times int", split, "number"), "asked")
    size = asked.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    parts = max(1, -(-named.count() // ITEMS))
    held = index.shards.filter("term IS NOT NULL")
    small = size <= SENT_BYTES
    wanted = asked.select("term").distinct()
    df_of = held.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").groupBy("term").agg(F.sum("rows").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    uses = (
        asked.join(df_of, "term")
        .withColumn("part", F.pmod(F.xxhash64("number"), F.lit(parts)))
        .groupBy("part", "term")
        .agg(F.first(weight).alias("weight"), F.collect_list(F.struct("number", "times")).alias("uses"))
    )
    uses = cut_lineage(uses, "uses")
    lists = held.join(F.broadcast(uses) if small else uses, "term").select(
        "part", "shard", "weight", "uses", "tops", "lasts", "ends", "data", F.lit(None).cast(index.shards.schema["ids"].dataType).alias("ids"), "lengths"
    )
    # the ids and lengths of a shard go to every part of the items
    heads = index.shards.filter("term IS NULL").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"),
        "shard",
        F.lit(None).cast("bigint").alias("weight"),
        F.lit(None).cast(uses.schema["uses"].dataType).alias("uses"),
        "tops",
        "lasts",
        "ends",
        "data",
        "ids",
        "lengths",
    )
    out = T.StructType([T.StructField("number", T.LongType()), T.StructField("id", id_kind), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(out)

    def find(table: pa.Table) -> pa.Table:
        head = pc.is_null(table["weight"])
        ids, lengths, n = None, None, []
        for row in table.filter(head).select(["ids", "lengths"]).to_batches():
            for k in range(row.num_rows):
                ids, lengths = row["ids"][k].values, row["lengths"][k].values.to_numpy(zero_copy_only=False)
        rows = table.filter(pc.invert(head))
        places = np.empty(len(ids), np.int64)
        places[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        of_item: dict[int, list[tuple[int, Postings]]] = {}
        for w, users, tops, lasts, ends, data in zip(*(rows[c].to_pylist() for c in ("weight", "uses", "tops", "lasts", "ends", "data"))):
            postings = Postings(np.array(tops), np.array(lasts), np.array(ends), data)
            for use in users:
                of_item.setdefault(use["number"], []).append((w * use["times"], postings))
        numbers, at, scores = [], [], []
        for number, own in of_item.items():
            found, score = best_rows(own, lengths, places, top)
            numbers += [number] * len(found)
            at.append(found)
            scores.append(score)
        none = np.zeros(0, np.int64)
        at, scores = np.concatenate([none, *at]), np.concatenate([none, *scores])
        return pa.Table.from_arrays([pa.array(numbers, pa.int64()), ids.take(pa.array(at)), pa.array(scores)], schema=arrow)

    found = lists.unionByName(heads).groupBy("part", "shard").applyInArrow(find, out)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(named.select("number", "item"), "number").select(
        F.col("item").cast(item_kind).alias(item_id), "rank", F.col("id").alias(id_col), "score"
    )
