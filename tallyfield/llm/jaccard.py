"""Join of texts by the Jaccard similarity of their word shingles, with signature trees.

A text's set holds the hashes of its distinct shingles of five words (ASCII letters in lower case). Texts with the
same set are one from here on. Two sets link if 100 * common >= 80 * united; nothing below can lose a link:

1. Frequent shingles are counted over all texts, to put them last in the order in which sets are cut.
2. Sets that link share a shingle among the first n - ceil(0.8 n) + 1 of their order. These are dealt by shingle.
   Few sets on a shingle give pairs, as far as their sizes, positions and token bitmaps leave a link possible. Many
   are held in signature trees: leaves of similar sets, nodes with the OR of their token bitmaps, their range of
   sizes and least number of bits. A dual traversal leaves out node pairs whose greatest possible overlap is too
   small or whose sets are connected already, and gives edges that connect all sets that may link.
3. Components of these edges are families. The sets of a family meet in one signature tree, whose traversal
   compares exactly what the bitmaps leave possible. Groups and families too large for one task are dealt in parts,
   and each two parts meet in a task.
4. Components of the links are the result.

Defined results: a text without words has an empty set and links with nothing; a text of fewer than five words is
one shingle; rows with the same id count as rows of their own; a component of rows without id has none; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_bytes, column_of, free_names, mix, shingle_hashes, slices, without_ids
from .components import components
from .leaks import word_hashes

WORDS = 5
#: Frequent shingles that are put last, at most, and how often a task must see one to report it.
HOT, HOT_IN_TASK = 1 << 16, 8
#: Sets on one shingle that give pairs; more are held in trees, so many in a task, about.
PAIRED, GROUP = 16, 4096
#: Bits of a set's bitmap: the power of two from its size, within bounds.
LEAST_BITS, MOST_BITS = 64, 8192
#: Shingles of the sets that meet in one task, about; a family with more is dealt in parts.
PART = 1 << 20
LEAF = 32
FILTER_SLOTS = 1 << 24


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), words))


def set_id(items: np.ndarray) -> int:
    """Signed 64-bit identity of a set."""
    total = mix(mix(items) + np.uint64(len(items))).sum(dtype=np.uint64) if len(items) else np.uint64(0)
    return int(np.array([total]).view(np.int64)[0])


def least_common(a, b):
    """Common shingles that sets of these sizes need to link: 100 c >= 80 (a + b - c)."""
    return -(-4 * (a + b) // 9)


def bits_of(n: int) -> int:
    bits = LEAST_BITS
    while bits < n and bits < MOST_BITS:
        bits *= 2
    return bits


def bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of a bitmap with the bit of every item set; half the bits are the OR of two halves."""
    marks = np.zeros(bits, np.uint8)
    marks[(items & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks)


def fold(bitmaps: np.ndarray, size: int) -> np.ndarray:
    while bitmaps.shape[-1] > size:
        half = bitmaps.shape[-1] // 2
        bitmaps = bitmaps[..., :half] | bitmaps[..., half:]
    return bitmaps


def frequent_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """The most frequent shingles in ascending order of frequency; at most HOT."""

    def run(batches):
        held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                new = np.sort(np.concatenate([shingle_set(t) for t in as_bytes(column_of(part, text_col))]))
                first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(new)))
                some = n > 1
                all_, at = np.unique(np.concatenate([held, new[first][some]]), return_inverse=True)
                held, counts = all_, np.bincount(at, np.concatenate([counts, n[some]]), len(all_)).astype(np.int64)
        often = counts >= HOT_IN_TASK
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(held[often].view(np.int64)), "n": pa.array(counts[often])})

    seen = docs.select(text_col).mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.col("n").desc(), "shingle").limit(HOT).collect()
    return np.array([r[0] for r in reversed(top)], np.int64).view(np.uint64)


def describe_sets(docs: DataFrame, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set) for every row; the first row of a set in a task also carries its bitmap and its prefix."""
    kind = docs.schema[id_col].dataType.simpleString()
    order = np.argsort(hot)
    ranked = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def run(batches):
        known, place = ranked.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, text_col):
                n, sets, maps, prefixes = [], [], [], []
                for text in as_bytes(column_of(part, text_col)):
                    items = shingle_set(text)
                    n.append(len(items))
                    if not len(items):
                        sets.append(None)
                        maps.append(None)
                        prefixes.append(None)
                        continue
                    own = set_id(items)
                    sets.append(own)
                    if own in seen:
                        maps.append(None)
                        prefixes.append(None)
                        continue
                    seen.add(own)
                    maps.append(bitmap(items, bits_of(len(items))).tobytes())
                    cut = len(items) + (-8 * len(items) // 10) + 1
                    if len(known):
                        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
                        is_hot = known[at] == items
                        late = np.flatnonzero(is_hot)
                        late = late[np.argsort(place[at[late]])]
                        items = np.concatenate([items[~is_hot], items[late]])
                    prefixes.append(items[:cut].view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": column_of(part, id_col),
                        "n": pa.array(n, pa.int64()),
                        "set": pa.array(sets, pa.int64()),
                        "bits": pa.array(maps, pa.binary()),
                        "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                    }
                )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, n bigint, set bigint, bits binary, prefix array<bigint>"
    )


def shared_prefixes(entries: DataFrame) -> DataFrame:
    """(a, b, shingle) from (shingle, set, n, place): pairs that may link, without shingle, and the sets ``b`` of each
    shingle that more than PAIRED sets share, beside the first of them."""

    def run(batches):
        # sorted by shingle and set; the last shingle of a batch may go on in the next one
        rest = None
        for batch in batches:
            columns = [column_of(batch, c).to_numpy() for c in ("shingle", "set", "n", "place")]
            if rest is not None:
                columns = [np.concatenate([r, c]) for r, c in zip(rest, columns)]
            if not len(columns[0]):
                continue
            columns = _different(columns)
            last = np.searchsorted(columns[0], columns[0][-1])
            rest = [c[last : last + PAIRED + 1] for c in columns]
            # of a shingle that many sets share, the first ones stand for it in the next batch
            going_on = len(columns[0]) - last > PAIRED
            yield _edges(columns if going_on else [c[:last] for c in columns])
        if rest is not None:
            yield _edges(rest)

    dealt = entries.repartition("shingle").sortWithinPartitions("shingle", "set")
    return dealt.mapInArrow(run, "a bigint, b bigint, shingle bigint").distinct()


def _different(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Without repeated sets on a shingle."""
    shingle, sets = columns[:2]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (sets[1:] != sets[:-1])
    return [c[fresh] for c in columns]


def _edges(columns: list[np.ndarray]) -> pa.RecordBatch:
    shingle, sets, n, place = columns
    a, b, shared = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.nulls(0, pa.int64())]
    if len(shingle):
        first = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        group = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(shingle)))[group]
        at = np.arange(len(shingle))
        for step in range(1, PAIRED):
            x = at[: len(at) - step]
            x = x[(group[x] == group[x + step]) & (size[x] <= PAIRED)] if len(x) else x
            if not len(x):
                break
            y = x + step
            need = least_common(n[x], n[y])
            # before the first common shingle nothing is common, so what follows must be enough
            good = np.minimum(n[x] - place[x], n[y] - place[y]) >= need
            a.append(sets[x[good]])
            b.append(sets[y[good]])
            shared.append(pa.nulls(int(good.sum()), pa.int64()))
        star = at[(size > PAIRED) & ~first]
        a.append(sets[begin[group[star]]])
        b.append(sets[star])
        shared.append(pa.array(shingle[star]))
    return pa.RecordBatch.from_pydict(
        {"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b)), "shingle": pa.concat_arrays(shared)}
    )


def possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps leave possible."""
    left = maps.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = maps.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

    def run(batches):
        for batch in batches:
            c = {n: column_of(batch, n) for n in batch.schema.names}
            good = []
            for n_a, n_b, x, y in zip(*(c[k].to_pylist() for k in ("n_a", "n_b", "bits_a", "bits_b"))):
                size = min(len(x), len(y))
                x, y = fold(np.frombuffer(x, np.uint8), size), fold(np.frombuffer(y, np.uint8), size)
                most = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
                good.append(most >= least_common(n_a, n_b))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": c["a"].filter(good), "b": c["b"].filter(good)})

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint")


class SignatureTree:
    """Sets in leaves of LEAF, sorted so that similar ones stand together; each node has the OR of the bitmaps below
    it, the range of sizes and the least number of bits."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        first_bit = np.unpackbits(maps, axis=1).argmax(1)
        self.order = np.lexsort((sizes, first_bit))
        self.sizes, self.maps = sizes[self.order], maps[self.order]
        ones = np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        n = len(sizes)
        self.ranges = [(k, min(k + LEAF, n)) for k in range(0, n, LEAF)]
        nodes = [(np.bitwise_or.reduce(self.maps[a:b]), self.sizes[a:b].min(), self.sizes[a:b].max(), ones[a:b].min()) for a, b in self.ranges]
        self.levels = [nodes]
        while len(nodes) > 1:
            pairs = [nodes[k : k + 2] for k in range(0, len(nodes), 2)]
            nodes = [
                (np.bitwise_or.reduce([x[0] for x in p]), min(x[1] for x in p), max(x[2] for x in p), min(x[3] for x in p))
                for p in pairs
            ]
            self.levels.append(nodes)

    def _possible(self, x, y) -> bool:
        """Whether any sets below two nodes can link: what both sides' bitmaps have in common bounds the overlap."""
        common = int(np.bitwise_count(x[0] & y[0]).sum())
        most = min(x[2] - max(0, x[3] - common), y[2] - max(0, y[3] - common), x[2], y[2])
        return most >= least_common(x[1], y[1])

    def links(self, label: np.ndarray, sides: np.ndarray | None = None, common=None) -> list[tuple[int, int]]:
        """Pairs of places that connect all sets connected by links at all; ``label`` tells which are already.

        With ``sides``, only sets of different sides are compared. ``common(p, q)`` counts common shingles; without
        it a pair that the bitmaps leave possible counts as linked.
        """
        own = label[self.order]
        side = None if sides is None else np.asarray(sides)[self.order]
        found = []
        open_ = [(len(self.levels) - 1, 0, 0)]
        while open_:
            level, i, j = open_.pop()
            if not self._possible(self.levels[level][i], self.levels[level][j]):
                continue
            if level:
                width = len(self.levels[level - 1])
                left = [k for k in (2 * i, 2 * i + 1) if k < width]
                right = [k for k in (2 * j, 2 * j + 1) if k < width]
                open_ += [(level - 1, a, b) for a in left for b in right if i != j or a <= b]
                continue
            (a0, a1), (b0, b1) = self.ranges[i], self.ranges[j]
            apart = own[a0:a1, None] != own[None, b0:b1]
            if side is not None:
                apart &= side[a0:a1, None] != side[None, b0:b1]
            if i == j:
                apart = np.triu(apart, 1)
            if not apart.any():
                continue
            x, y = self.maps[a0:a1, None], self.maps[None, b0:b1]
            nx, ny = self.sizes[a0:a1, None], self.sizes[None, b0:b1]
            outside = [np.bitwise_count(p & ~q).sum(2, dtype=np.int64) for p, q in ((x, y), (y, x))]
            most, need = np.minimum(nx - outside[0], ny - outside[1]), least_common(nx, ny)
            rows, columns = np.nonzero(apart & (most >= need))
            best = np.argsort((need - most)[rows, columns], kind="stable")
            for r, c in zip(rows[best].tolist(), columns[best].tolist()):
                p, q = a0 + r, b0 + c
                if own[p] == own[q]:
                    continue
                at = int(self.order[p]), int(self.order[q])
                if common is None or common(*at) >= need[r, c]:
                    found.append(at)
                    own[own == own[q]] = own[p]
        label[self.order] = own
        return found


def exact_links(sets: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all of these sets that links connect."""
    sizes = np.array([len(x) for x in sets])
    bits = bits_of(int(sizes.max()))
    tree = SignatureTree(sizes, np.stack([bitmap(x, bits) for x in sets]))
    return tree.links(np.arange(len(sets)), sides, lambda p, q: common_items(sets[p], sets[q]))


def possible_links(sizes: np.ndarray, maps: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect all sets that may link by their bitmaps. Sets that link have bitmaps of the same or of
    neighbouring lengths, so each length is compared with itself and, folded, with the next one."""
    widths = np.array([len(m) for m in maps])
    label, found = np.arange(len(maps)), []
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        above = np.flatnonzero((widths == 2 * width) & (sizes * 4 <= sizes[own].max() * 5))
        compared = [(own, None if sides is None else sides[own])]
        if len(above):
            both = np.concatenate([own, above])
            compared.append((both, widths[both]))
        for some, side in compared:
            if len(some) < 2:
                continue
            tree = SignatureTree(sizes[some], np.stack([fold(maps[k], width) for k in some]))
            for p, q in tree.links(label[some], side):
                p, q = int(some[p]), int(some[q])
                found.append((p, q))
                label[label == label[q]] = label[p]
    return found


def common_items(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def in_blocks(members: DataFrame, group: str, parts: Column) -> DataFrame:
    """Members with their part of the group and the blocks (i, j) they meet others in: a group in one part meets in
    one block, otherwise each two of its parts do."""
    counted = members.groupBy(group).agg(F.ceil(parts).cast("int").alias("parts"))
    placed = members.join(counted, group).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))

    def block(k: Column) -> Column:
        return F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j"))

    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), block)).alias("block")
    return placed.select(*members.columns, "part", met)


def group_edges(groups: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b) edges that connect, within each shingle's sets, those that may link; groups has (shingle, set)."""
    blocks = in_blocks(groups, "shingle", F.count(F.lit(1)) / F.lit(GROUP)).join(maps, "set")

    def compare(key, rows):
        ids, part = rows.column("set").to_numpy(), rows.column("part").to_numpy()
        maps = [np.frombuffer(x, np.uint8) for x in rows.column("bits").to_pylist()]
        found = possible_links(rows.column("n").to_numpy(), maps, None if key[1] == key[2] else part)
        return pa.table({"a": pa.array([int(ids[p]) for p, _ in found], pa.int64()), "b": pa.array([int(ids[q]) for _, q in found], pa.int64())})

    met = blocks.select("shingle", "block.i", "block.j", "set", "part", "n", "bits")
    return met.groupBy("shingle", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def family_links(docs: DataFrame, families: DataFrame, sizes: DataFrame, text_col: str) -> DataFrame:
    """(a, b) links that connect the sets of each family; families has (node, label)."""
    spark = docs.sparkSession
    members = families.join(sizes, F.col("node") == F.col("set")).select("set", F.col("label").alias("family"), "n")
    members = cut_lineage(members, "members")
    slots = np.zeros(FILTER_SLOTS, bool)
    wanted = members.select((F.col("set").bitwiseAND(FILTER_SLOTS - 1)).cast("int").alias("slot")).distinct()
    slots[wanted.toArrow().column("slot").to_numpy()] = True
    passing = spark.sparkContext.broadcast(np.packbits(slots))

    def read(batches):
        marks, seen = np.unpackbits(passing.value), set()
        for batch in batches:
            for part in slices(batch, text_col):
                sets, items = [], []
                for text in as_bytes(column_of(part, text_col)):
                    some = shingle_set(text)
                    own = set_id(some)
                    if len(some) and marks[own & (FILTER_SLOTS - 1)] and own not in seen:
                        seen.add(own)
                        sets.append(own)
                        items.append(some.tobytes())
                yield pa.RecordBatch.from_pydict({"set": pa.array(sets, pa.int64()), "items": pa.array(items, pa.binary())})

    blocks = in_blocks(members, "family", F.sum("n") / F.lit(PART))
    # the copies of a set that different tasks have read are dropped with the blocks' members
    sets = docs.select(text_col).mapInArrow(read, "set bigint, items binary")
    met = blocks.join(sets, "set").select("family", "block.i", "block.j", "part", "set", "items")
    kept_schema = "a bigint, b bigint"

    def compare(key, rows):
        ids = rows.column("set").to_numpy()
        _, first = np.unique(ids, return_index=True)
        ids, part = ids[first], rows.column("part").to_numpy()[first]
        items = rows.column("items").combine_chunks()
        sets = [np.frombuffer(items[k].as_buffer(), np.uint64) for k in first.tolist()]
        i, j = key[1].as_py(), key[2].as_py()
        found = exact_links(sets, None if i == j else part)
        return pa.table({"a": pa.array([int(ids[p]) for p, _ in found], pa.int64()), "b": pa.array([int(ids[q]) for _, q in found], pa.int64())})

    return met.groupBy("family", "i", "j").applyInArrow(compare, kept_schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set, class, low) for every row: its set, the component of the set and the component's
    smallest id (null if the component has no other row)."""
    hot = frequent_shingles(docs, text_col)
    rows = cut_lineage(describe_sets(docs, hot, id_col, text_col), "sets")
    first = rows.filter("prefix is not null")
    entries = first.select("set", "n", F.posexplode("prefix").alias("place", "shingle"))
    edges = cut_lineage(shared_prefixes(entries), "edges")
    maps = first.groupBy("set").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    maps = cut_lineage(maps, "maps")
    pairs = possible(edges.filter("shingle is null").select("a", "b"), maps)
    crowds = edges.filter("shingle is not null")
    crowds = crowds.select("shingle", F.col("b").alias("set")).union(crowds.select("shingle", "a").distinct())
    families = components(pairs.union(group_edges(crowds, maps)))
    linked = components(family_links(docs, families, maps.select("set", "n"), text_col))
    owner = rows.select("id", F.col("n").alias("n_shingles"), "set")
    owner = owner.join(linked.select(F.col("node").alias("set"), "label"), "set", "left")
    owner = owner.withColumn("class", F.coalesce("label", "set"))
    lowest = owner.filter("class is not null").groupBy("class").agg(F.min("id").alias("low"), F.count("*").alias("rows"))
    # only classes of several rows need their smallest id looked up
    shared = lowest.filter("rows > 1").select("class", "low")
    return owner.join(shared, "class", "left").select("id", "n_shingles", "set", "class", "low")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row; ``component_id`` is the smallest id reachable by links."""
    return classify(docs, id_col, text_col).select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("low", "id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, without all but one of each component: the one with the smallest id, of several
    with that id the one whose text has the smallest hash. Rows with an empty set, or without id, all stay."""
    found = cut_lineage(classify(docs, id_col, text_col).filter("low is not null"), "classes")
    twice = found.filter("id = low").groupBy("id", "class").agg(F.count("*").alias("rows")).filter("rows > 1")
    mixed = found.filter("id is not null").groupBy("id").agg(
        F.max((F.col("id") != F.col("low")).cast("int")).alias("goes"),
        F.count_distinct("class").alias("classes"),
    )
    # an id whose rows are not all of one fate is settled row by row
    settle = cut_lineage(
        twice.select("id").union(mixed.filter("goes = 1").select("id")).distinct().join(_repeated(docs, id_col), "id", "left_semi"),
        "settle",
    )
    goes = mixed.filter("goes = 1").select("id")
    if settle.isEmpty():
        return without_ids(docs, goes, id_col)
    clear = without_ids(docs, goes.union(settle), id_col)
    # columns beside the rows' own, under names that those do not have
    ident, made, digest, of_class, lowest_id, of, best_of = free_names(docs.columns, "id", "set", "hash", "class", "low", "of", "best")
    apart = settle.select(F.col("id").alias(ident))
    rows = docs.join(apart, docs[id_col] == F.col(ident), "left_semi")
    marked = _with_set(rows, text_col, made).withColumn(digest, F.xxhash64(text_col))
    classes = found.select(F.col("set").alias(made), F.col("class").alias(of_class), F.col("low").alias(lowest_id)).distinct()
    marked = marked.join(classes, made, "left")
    lowest = marked.filter(F.col(id_col) == F.col(lowest_id))
    best = lowest.groupBy(F.col(of_class).alias(of)).agg(F.min(digest).alias(best_of))
    chosen = lowest.join(best, (F.col(of_class) == F.col(of)) & (F.col(digest) == F.col(best_of)), "left_semi")
    alone = marked.filter(F.col(lowest_id).isNull()).select(*docs.columns)
    return clear.unionByName(alone).unionByName(chosen.dropDuplicates([of_class]).select(*docs.columns))


def _repeated(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("rows")).filter("rows > 1").select("id")


def _with_set(docs: DataFrame, text_col: str, made: str) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(made, T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                found = [shingle_set(t) for t in as_bytes(column_of(part, text_col))]
                ids = pa.array([set_id(x) if len(x) else None for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, made])

    return docs.mapInArrow(run, schema)
