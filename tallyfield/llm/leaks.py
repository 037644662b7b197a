"""Benchmark decontamination: CGK embedding, bit-sampling and exact edit verification.

Texts are sequences of words (ASCII letters in lower case). A CGK random walk reads a window and moves on, or
stays, by one random bit of the current word, so that windows at a small edit distance visit mostly the same words
at the same steps: edit distance becomes Hamming distance. A key is made of the words at a few sampled steps;
several walks with own bits and samples repeat the trial.

Windows begin where a word's hash is the least of some run of ``RUN`` neighbours, in items and documents alike, so
an unchanged beginning aligns them. Each of the windows of an item takes the largest size class that fits into
the rest of the item. All documents are read once, whole; only windows whose key passes a filter of fixed size
leave the scan, with their surroundings, and are joined to the items' keys and verified exactly.

An item shorter than ``PIECED`` words has few windows or none, so its pieces are keys as well: cut into one piece
more than the edits it may have, at least one piece occurs unchanged, and pieces are looked for at every word of the
documents. Such items are found always; longer ones with the chance of their windows' keys (README).

A document leaks an item if some run of its words is within ``share`` of the item's number of words in word edits,
one rule for every length. Defined results: null or empty texts and items match
nothing; equal rows count once; rows without an id are reported under a null id; empty tables give an empty
table; other columns are ignored. No candidate is capped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_bytes, column_of, let_go, mix, slices, without_ids

#: Words a window of each class has at least, and the words of its key.
CLASSES, SAMPLED = (9, 18, 36), (4, 5, 6)
WALKS, STEPS, RUN = 6, 64, 6
SHARE = 0.2
#: Items of fewer words are also looked for by their pieces.
PIECED = 36
#: Slots of the filter: as many as this a key, within bounds.
SLOTS_A_KEY, LEAST_SLOTS, MOST_SLOTS = 512, 1 << 20, 1 << 24
PAD = np.uint64(0x5851F42D4C957F2D)
SHORT = 99


@lru_cache(maxsize=1)
def samples() -> list[list[list[int]]]:
    """Sampled steps of each walk and class: one from each of equal parts of the steps that stay in the window."""
    draw = np.random.default_rng(20)
    out = []
    for _ in range(WALKS):
        walk = []
        for size, count in zip(CLASSES, SAMPLED):
            edges = np.linspace(0, min(STEPS, 1.6 * size), count + 1).astype(int)
            walk.append([int(draw.integers(a, b)) for a, b in zip(edges[:-1], edges[1:])])
        out.append(walk)
    return out


def word_hashes(text: bytes) -> np.ndarray:
    import xxhash

    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(words: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    """Places that hold the least hash, the first of equal ones, of some run of RUN words; ``inside`` marks words
    that are no padding."""
    n = len(words) - RUN + 1
    if n < 1:
        return np.zeros(0, np.int64)
    rank = mix(words + np.uint64(7))
    least, at = rank[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, RUN):
        lower = rank[k : n + k] < least
        np.copyto(least, rank[k : n + k], where=lower)
        at[lower] = k
    begin = np.arange(n)
    if inside is not None:
        begin = begin[inside[:n] & inside[RUN - 1 :]]
    chosen = np.zeros(len(words), bool)
    chosen[begin + at[begin]] = True
    return np.flatnonzero(chosen)


def walk_keys(words: np.ndarray, starts: np.ndarray) -> list[list[np.ndarray]]:
    """Keys by walk and class of the windows at ``starts``; ``words`` has STEPS words of padding after each text."""
    keys = []
    for walk, chosen in enumerate(samples()):
        bits = mix(words * np.uint64(0xD6E8FEB86659FD93) + np.uint64(walk + 1))
        place = starts.astype(np.int64)
        made = [np.full(len(starts), (walk << 8) | c, np.uint64) for c in range(len(CLASSES))]
        last = max(s for steps in chosen for s in steps)
        for step in range(last + 1):
            for c, steps in enumerate(chosen):
                if step in steps:
                    made[c] = mix((made[c] ^ words[place]) * np.uint64(0xD6E8FEB86659FD93))
            place += ((bits[place] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        keys.append(made)
    return keys


def short_keys(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Keys of every run of so many words, by size; a longer run's hash goes on from the shorter one's."""
    keys = {}
    out = np.zeros(len(words), np.uint64)
    for size in range(1, min(max(sizes, default=0), len(words)) + 1):
        out = mix(out[: len(words) - size + 1] * np.uint64(0xD6E8FEB86659FD93) + words[size - 1 :])
        if size in sizes:
            keys[size] = mix(out ^ np.uint64(SHORT + (size << 8)))
    return keys


def most_edits(size: int, share: float) -> int:
    """Edits that an item of so many words may have."""
    return int(share * size)


def piece_keys(words: np.ndarray, share: float) -> list[tuple[int, int, int]]:
    """(key, place, size) of the pieces of an item, one more than its edits."""
    cuts = np.linspace(0, len(words), min(most_edits(len(words), share) + 1, len(words)) + 1).astype(int).tolist()
    keys = short_keys(words, list({b - a for a, b in zip(cuts[:-1], cuts[1:])}))
    return [(int(keys[b - a][a]), a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def item_keys(items: DataFrame, id_col: str, text_col: str, share: float = SHARE) -> DataFrame:
    """(item, key, place, size, words): every key of every item, the place of its window or piece in the item, and
    the words of a piece (0 for a window)."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                out = {"item": [], "key": [], "place": [], "size": [], "words": []}
                for item, text in zip(column_of(part, id_col).to_pylist(), as_bytes(column_of(part, text_col))):
                    words = word_hashes(text)
                    found = piece_keys(words, share) if 0 < len(words) < PIECED else []
                    if len(words) >= CLASSES[0]:
                        at = anchors(words)
                        at = at[at + CLASSES[0] <= len(words)]
                        padded = np.concatenate([words, np.full(STEPS + 1, PAD)])
                        size = np.searchsorted(CLASSES, len(words) - at, side="right") - 1
                        for made in walk_keys(padded, at):
                            found += [(int(made[c][k]), int(at[k]), 0) for k, c in enumerate(size)]
                    for key, place, size in set(found):
                        out["item"].append(item)
                        out["key"].append(key)
                        out["place"].append(place)
                        out["size"].append(size)
                        out["words"].append(words.view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "item": pa.array(out["item"], part.schema.field(part.schema.get_field_index(id_col)).type),
                        "key": pa.array(np.array(out["key"], np.uint64).view(np.int64), pa.int64()),
                        "place": pa.array(out["place"], pa.int32()),
                        "size": pa.array(out["size"], pa.int32()),
                        "words": pa.array(out["words"], pa.list_(pa.int64())),
                    }
                )

    rows = items.select(id_col, text_col).distinct()
    return rows.mapInArrow(run, f"item {kind}, key bigint, place int, size int, words array<bigint>")


def _slots(keys: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(slots - 1)
    return (keys >> np.uint64(8)) & mask, (keys >> np.uint64(36)) & mask


def _passing(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the keys whose slots are both set; the second one is looked at where the first is set."""
    mask = np.uint64(len(table) - 1)
    passed = np.flatnonzero(table[(keys >> np.uint64(8)) & mask])
    return passed[table[(keys[passed] >> np.uint64(36)) & mask]]


def key_filter(keys: DataFrame) -> np.ndarray:
    """One byte a slot, set for both slots of every key; its size is bounded whatever the number of keys."""
    count = keys.count()
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and slots < SLOTS_A_KEY * count:
        slots *= 2

    def run(batches):
        for batch in batches:
            for at in _slots(column_of(batch, "key").to_numpy().view(np.uint64), slots):
                yield pa.RecordBatch.from_pydict({"slot": pa.array(np.unique(at).astype(np.int32))})

    table = np.zeros(slots, bool)
    table[keys.select("key").mapInArrow(run, "slot int").distinct().toArrow().column("slot").to_numpy()] = True
    return table


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
) -> DataFrame:
    """(id, item, distance, place): every item a document leaks, its least distance in word edits, and the first
    word of the document where a run at that distance is looked for."""
    spark = docs.sparkSession
    keyed = cut_lineage(item_keys(items, item_col, item_text, share), "items")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), keyed.schema["item"].dataType.simpleString()
    sizes = [r[0] for r in keyed.select("size").filter("size > 0").distinct().collect()]
    longest = keyed.agg(F.max(F.size("words"))).first()[0] or 0
    reach = int(longest * (1 + share)) + 1
    passing = spark.sparkContext.broadcast(key_filter(keyed))

    def scan(batches):
        table = passing.value
        for batch in batches:
            for part in slices(batch, text_col):
                yield _windows(part, id_col, text_col, table, sizes, reach)
        let_go()

    windows = docs.select(id_col, text_col).mapInArrow(
        scan, f"`{id_col}` {kind}, place int, before int, keys array<bigint>, near array<bigint>"
    )
    pairs = windows.select(
        F.col(id_col).alias("doc"), F.col("place").alias("at"), "before", "near", F.explode("keys").alias("key")
    ).join(keyed.withColumnRenamed("place", "within"), "key")

    def verify(batches):
        for batch in batches:
            c = {n: column_of(batch, n) for n in batch.schema.names}
            found = []
            for before, within, near, words in zip(*(c[n].to_pylist() for n in ("before", "within", "near", "words"))):
                most = most_edits(len(words), share)
                low = max(0, before - within - most)
                found.append(edit_distance(words, near[low : before - within + len(words) + most], most))
            good = pa.array([d is not None for d in found])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": c["doc"].filter(good),
                    "item": c["item"].filter(good),
                    "distance": pa.array([d for d in found if d is not None], pa.int32()),
                    "place": pa.array([max(0, a - w) for a, w, d in zip(c["at"].to_pylist(), c["within"].to_pylist(), found) if d is not None], pa.int32()),
                }
            )

    checked = pairs.mapInArrow(verify, f"doc {kind}, item {item_kind}, distance int, place int")
    # distance and place in one number, so that the aggregation stays a hash aggregation
    best = checked.groupBy("doc", "item").agg(
        F.min(F.col("distance").cast("bigint") * (1 << 32) + F.col("place")).alias("best")
    )
    return best.select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.shiftright("best", 32).cast("int").alias("distance"),
        F.col("best").bitwiseAND((1 << 32) - 1).cast("int").alias("place"),
    )


def _windows(part, id_col: str, text_col: str, table: np.ndarray, sizes: list[int], reach: int) -> pa.RecordBatch:
    texts = [word_hashes(t) for t in as_bytes(column_of(part, text_col))]
    pad = np.full(STEPS + 1, PAD)
    words = np.concatenate([x for t in texts for x in (t, pad)])
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + len(pad)) - lengths - len(pad)
    owner = np.repeat(np.arange(len(texts)), lengths + len(pad))
    inside = np.arange(len(words)) - begins[owner] < lengths[owner]
    starts = anchors(words, inside)
    hits = []
    for made in walk_keys(words, starts):
        for keys in made:
            passed = _passing(keys, table)
            hits.append((starts[passed], keys[passed]))
    for keys in short_keys(words, sizes).values():
        passed = _passing(keys, table)
        passed = passed[inside[passed]]
        hits.append((passed, keys[passed]))
    at, keys = (np.concatenate(x) for x in zip(*hits))
    order = np.argsort(at, kind="stable")
    at, keys = at[order], keys[order]
    places, first = np.unique(at, return_index=True)
    groups = np.split(keys.view(np.int64), first[1:]) if len(places) else []
    who = owner[places]
    low = np.maximum(places - reach, begins[who])
    high = np.minimum(places + reach, begins[who] + lengths[who])
    return pa.RecordBatch.from_pydict(
        {
            id_col: column_of(part, id_col).take(pa.array(who, pa.int64())),
            "place": pa.array((places - begins[who]).astype(np.int32)),
            "before": pa.array((places - low).astype(np.int32)),
            "keys": pa.array([np.unique(g) for g in groups], pa.list_(pa.int64())),
            "near": pa.array([words[a:b].view(np.int64) for a, b in zip(low, high)], pa.list_(pa.int64())),
        }
    )


def edit_distance(item: list[int], near: list[int], most: int) -> int | None:
    """Least number of word edits between an item and any run of the neighbouring words; None if above ``most``."""
    n = len(item)
    if not n:
        return None
    if any(near[k : k + n] == item for k in range(len(near) - n + 1)):
        return 0
    if not most:
        return None
    text = np.array(near, np.int64)
    line = np.zeros(len(near) + 1, np.int64)
    rising = np.arange(len(near) + 1)
    for i, word in enumerate(item, 1):
        nexts = np.minimum(line[:-1] + (text != word), line[1:] + 1)
        nexts = np.concatenate([[i], nexts])
        line = np.minimum.accumulate(nexts - rising) + rising
        if line.min() > most:
            return None
    return int(line.min()) if line.min() <= most else None


def clean_documents(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows, with all columns, whose id leaks no item."""
    return without_ids(docs, leaks.select(id_col), id_col)
