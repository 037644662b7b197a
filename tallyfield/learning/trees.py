"""Regularised boosting and forests with random cuts, grown level by level from histograms.

Features are cut into bins once. A pass over the binned rows sums first and second derivatives per node, feature and
bin: for one tree of a booster, or for many trees of a forest at once. The sums, whose size depends on nodes, features
and bins alone, are added up on the executors and the splits are chosen on the driver; no row leaves its task.

A booster's margins are recomputed from the trees since they were last written, so a pass depends on a written table
and on the model only, and can be repeated after an executor is lost.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .reduce import summed
from .rounds import SEED, best_round

#: Bins of a feature, doubles of sums held by a task, and trees after which margins are written.
BINS, MOST_SUMS, WRITTEN = 64, 1 << 22, 16


@dataclass
class Tree:
    """Nodes as arrays; ``left`` is -1 for a leaf. A row goes left if its feature's bin is at most ``cut``."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float = 0.0) -> int:
        for own, start in ((self.feature, -1), (self.cut, -1), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0)):
            own.append(start)
        return len(self.left) - 1

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = self.add(), self.add()
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The last node that each row of bins comes to."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        going = np.arange(len(bins))
        while len(going := going[left[at[going]] >= 0]):
            now = at[going]
            goes_left = bins[going, feature[now]] <= cut[now]
            at[going] = np.where(goes_left, left[now], right[now])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]

    def leaves(self) -> int:
        return sum(x < 0 for x in self.left)

    def capped(self, most: int) -> Tree:
        """The tree that growing by the greatest gain first makes with at most ``most`` leaves: a split depends on its
        node alone, so it is what best-first growth takes from this tree."""
        out, order = Tree(), 0
        out.add(self.value[0])
        waiting = [(-self.gain[0], order, 0, 0)] if self.left[0] >= 0 else []
        held = 1
        while waiting and held < most:
            _, _, here, there = heapq.heappop(waiting)
            pair = out.split(there, self.feature[here], self.cut[here], self.gain[here])
            held += 1
            for node, made in zip((self.left[here], self.right[here]), pair):
                out.value[made] = self.value[node]
                if self.left[node] >= 0:
                    order += 1
                    heapq.heappush(waiting, (-self.gain[node], order, node, made))
        return out


@dataclass(frozen=True)
class TreeModel:
    """Trees over binned features: a booster adds up margins, a forest takes the mean of shares."""

    edges: list[np.ndarray]
    trees: list[Tree]
    boosted: bool

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        total = sum((t.values(bins) for t in self.trees), np.zeros(len(x)))
        if self.boosted:
            return 1 / (1 + np.exp(-total))
        return total / max(1, len(self.trees))

    def probability(self, features: str = "features") -> Column:
        model = self

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype="float64")

        return score(vector_to_array(F.col(features)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of edges below each value: values up to an edge lie in its bin or before."""
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1).astype(np.int64)


def feature_edges(df: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: all distinct values if there are few, else those at equal
    shares of the rows."""
    first = df.select(F.size(vector_to_array("features"))).first()
    if first is None:
        raise ValueError("no rows to fit")
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    x = df.select(vector_to_array("features").alias("x"))

    def told(k):
        v = F.col("x")[k]
        return F.struct(F.percentile_approx(v, shares, 10_000).alias("at"), F.max(v).alias("top"), F.approx_count_distinct(v).alias("n")).alias(f"f{k}")

    row = x.agg(*[told(k) for k in range(first[0])]).first()
    few = [k for k in range(first[0]) if row[k]["n"] <= bins]
    sets = dict(zip(few, x.agg(*[F.collect_set(F.col("x")[k]) for k in few]).first())) if few else {}
    edges = []
    for k in range(first[0]):
        own = np.unique(np.array(sets[k] if len(sets.get(k, ())) in range(1, bins + 1) else row[k]["at"], float))
        edges.append(own[own < row[k]["top"]])
    return edges


def binned_rows(
    df: DataFrame, label: str, edges: list[np.ndarray], weight: str | None = None, validation: str | None = None, fold: str | None = None
) -> DataFrame:
    """(bins, y, w, val, draw, fold, margin), written once; ``draw`` is a number of the row's own for sampling."""
    rows = df.select(
        vector_to_array("features").alias("x"),
        F.col(label).cast("double").alias("y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        (F.col(validation) if validation else F.lit(False)).alias("val"),
        F.xxhash64(F.monotonically_increasing_id(), F.lit(SEED)).alias("draw"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
    )

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = [r.tobytes() for r in binned(x, edges).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), *batch.columns[1:], pa.array(np.zeros(len(bins)))], names=["bins", "y", "w", "val", "draw", "fold", "margin"])

    schema = "bins binary, y double, w double, val boolean, draw bigint, fold int, margin double"
    return cut_lineage(rows.mapInArrow(run, schema), "binned")


@dataclass(frozen=True)
class _Rows:
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    val: np.ndarray
    draw: np.ndarray
    fold: np.ndarray
    margin: np.ndarray


def _read(batch: pa.RecordBatch) -> _Rows:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, -1).astype(np.int64)
    return _Rows(bins, *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:7]))


def sampled(draw: np.ndarray, w: np.ndarray, tree: int, share: float, replace: bool = False) -> np.ndarray:
    """Weights of the rows in a tree's sample: a row that stands for w rows keeps about ``share`` of them, or, with
    ``replace``, as many as drawing each of them with return would give. Depends on the row's number and the tree only."""
    if share >= 1 and not replace:
        return w
    z = (draw.view(np.uint64) ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    u = ((z ^ (z >> np.uint64(29))) >> np.uint64(11)).astype(float) / 2**53
    if not replace:
        return np.floor(w * share + u)
    mean, out, term, below = w * share, np.zeros(len(w)), np.exp(-np.minimum(w * share, 700)), np.zeros(len(w))
    large = mean > 30  # the spread of a Poisson number is small beside its mean
    for k in range(1, 120):
        below = below + term
        out += (u >= below) & ~large
        term = term * mean / k
    return np.where(large, np.floor(mean + u), out)


def _histograms(rows: _Rows, node: np.ndarray, first: np.ndarray, second: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """(nodes, features, bins, 2) sums; rows whose ``node`` is negative are left out."""
    keep = node >= 0
    bins, node, first, second = rows.bins[keep], node[keep], first[keep], second[keep]
    d = bins.shape[1]
    out = np.zeros((nodes, d, width, 2))
    for k in range(d):
        at = node * width + bins[:, k]
        for side, own in enumerate((first, second)):
            out[:, k, :, side] = np.bincount(at, own, nodes * width).reshape(nodes, width)
    return out


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


@dataclass(frozen=True)
class Boosting:
    """Parameters by their usual names; penalties act on the leaf weights, ``gamma`` on a split's gain."""

    n_estimators: int = 1000
    max_depth: int = 6
    learning_rate: float = 0.3
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    patience: int | None = None

    def weight(self, g, h):
        """Value of a leaf with these sums of first and second derivatives."""
        return -_shrunk(np.asarray(g, float), self.reg_alpha) / (np.asarray(h, float) + self.reg_lambda + 1e-300)

    def worth(self, g, h):
        return _shrunk(np.asarray(g, float), self.reg_alpha) ** 2 / (np.asarray(h, float) + self.reg_lambda + 1e-300)

    def best_split(self, sums: np.ndarray, features: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, bin) of the best split of a node by its (features, bins, 2) sums; gain 0 if there is none."""
        left = np.cumsum(sums[features], axis=1)[:, :-1]
        total = sums[features].sum(1)[:, None]
        right = total - left
        gain = 0.5 * (self.worth(left[..., 0], left[..., 1]) + self.worth(right[..., 0], right[..., 1]) - self.worth(total[..., 0], total[..., 1])) - self.gamma
        gain[(left[..., 1] < self.min_child_weight) | (right[..., 1] < self.min_child_weight)] = -np.inf
        k, b = np.unravel_index(np.argmax(gain), gain.shape)
        return (float(gain[k, b]), int(features[k]), int(b)) if gain[k, b] > 1e-12 else (0.0, -1, -1)


def fit_boosting(df: DataFrame, label: str, params: Boosting, weight: str | None = None, validation: str | None = None) -> TreeModel:
    """Gradient boosting of the log loss. With ``patience``, ends when so many rounds brought nothing better on the
    rows that ``validation`` marks, and keeps the trees up to the best round."""
    train = df.where(~F.col(validation)) if validation else df
    edges = feature_edges(train)
    rows = binned_rows(df, label, edges, weight, validation)
    width, d = max((len(e) for e in edges), default=0) + 1, len(edges)
    rng = np.random.default_rng(SEED)
    done, recent, losses = [], [], []

    def margins(r: _Rows, trees: list[Tree]) -> np.ndarray:
        return sum((t.values(r.bins) for t in trees), r.margin)

    def pass_over(tree: Tree, wanted: list[int], number: int, recent: list[Tree]) -> tuple[np.ndarray, float]:
        """Histograms of the wanted nodes, and the mean loss of the validation rows before this tree."""
        place = np.full(len(tree.left), -1)
        place[wanted] = np.arange(len(wanted))

        def add(total, batch):
            r = _read(batch)
            z = margins(r, recent)
            p = 1 / (1 + np.exp(-z))
            w = np.where(r.val, 0.0, sampled(r.draw, r.w, number, params.subsample))
            node = np.where(w > 0, place[tree.nodes(r.bins)], -1)
            total[:-1] += _histograms(r, node, w * (p - r.y), w * p * (1 - p), len(wanted), width).reshape(len(wanted), -1)
            total[-1, 0] += (r.w * r.val) @ (np.logaddexp(0, z) - r.y * z)
            total[-1, 1] += r.w @ r.val

        sums = summed(rows, len(wanted) + 1, d * width * 2, add)
        loss = sums[-1, 0] / sums[-1, 1] if sums[-1, 1] else math.nan
        return sums[:-1].reshape(len(wanted), d, width, 2), loss

    def value(sums: np.ndarray) -> float:
        return params.learning_rate * float(params.weight(*sums)) if sums[1] > 0 else 0.0

    def settled() -> bool:
        return params.patience is not None and not math.isnan(losses[0]) and best_round(losses, params.patience) + params.patience <= len(losses)

    for number in range(params.n_estimators):
        tree = Tree()
        level = [tree.add()]
        features = np.sort(rng.choice(d, max(1, math.ceil(params.colsample_bytree * d)), replace=False))
        for depth in range(max(1, params.max_depth)):
            sums, loss = pass_over(tree, level, number, recent)
            if not depth and number:
                losses.append(loss)
                if settled():
                    break
            below = []
            for node, own in zip(level, sums):
                if not depth:
                    tree.value[node] = value(own[0].sum(0))
                gain, k, b = params.best_split(own, features) if depth < params.max_depth else (0.0, -1, -1)
                if gain > 0:
                    # the children's sums are parts of their parent's
                    sides = own[k, : b + 1].sum(0), own[k, b + 1 :].sum(0)
                    pair = tree.split(node, k, b, gain)
                    for child, side in zip(pair, sides):
                        tree.value[child] = value(side)
                    below += pair
            level = below
            if not level:
                break
        if losses and settled():
            break
        done.append(tree)
        recent.append(tree)
        if len(recent) == WRITTEN:
            rows, recent = _written(rows, recent), []
    else:
        if params.patience is not None:
            none = Tree()
            losses.append(pass_over(none, [none.add()], len(done), recent)[1])
    if params.patience is not None and losses and not math.isnan(losses[0]):
        done = done[: best_round(losses, params.patience)]
    return TreeModel(edges, done, True)


def _written(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    def run(batches):
        for batch in batches:
            r = _read(batch)
            margin = sum((t.values(r.bins) for t in trees), r.margin)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(margin)], names=batch.schema.names)

    return cut_lineage(rows.mapInArrow(run, rows.schema), "binned")


@dataclass(frozen=True)
class Forest:
    """Trees on all rows, or on a sample with return; each node looks at ``features`` of the columns (None: the
    square root of their number), at all cuts or at one drawn uniformly from the node's range."""

    n_estimators: int = 100
    max_depth: int = 10
    max_leaf_nodes: int | None = None
    bootstrap: bool = False
    random_cuts: bool = True
    features: int | None = None
    min_child_weight: float = 1.0

    def splits(self, sums: np.ndarray, edges: list[np.ndarray], tops: np.ndarray, rng) -> tuple[float, int, int]:
        """(gain, feature, bin) of a node from sums of labels and weights per feature and bin: the fall of the
        weighted Gini impurity."""
        d = len(edges)
        usable = [k for k in range(d) if (sums[k, :, 1] > 0).sum() > 1]
        if not usable:
            return 0.0, -1, -1
        wanted = self.features or max(1, math.isqrt(d))
        best = (0.0, -1, -1)
        # features that cannot be cut do not count among those looked at
        for k in rng.permutation(usable)[:wanted]:
            ones, weight = np.cumsum(sums[k, :, 0]), np.cumsum(sums[k, :, 1])
            held = np.flatnonzero(sums[k, :, 1] > 0)
            cuts = np.arange(held[0], held[-1])
            if self.random_cuts:
                cuts = np.array([random_cut(edges[k], tops[k], held[0], held[-1], rng)])
            n, left, right = weight[-1], weight[cuts], weight[-1] - weight[cuts]
            a, b = ones[cuts], ones[-1] - ones[cuts]
            fine = (left >= self.min_child_weight) & (right >= self.min_child_weight)
            if not fine.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fine, a * a / left + (left - a) ** 2 / left + b * b / right + (right - b) ** 2 / right, -np.inf)
            at = int(np.argmax(gain))
            fall = float(gain[at] - (ones[-1] ** 2 + (n - ones[-1]) ** 2) / n)
            if fall > best[0] + 1e-12:
                best = (fall, int(k), int(cuts[at]))
        return best


def random_cut(edges: np.ndarray, top: float, low: int, high: int, rng) -> int:
    """A bin from ``low`` to before ``high``: that of a value drawn uniformly from the node's range, which ends at the
    upper edges of the two bins."""
    ends = np.append(edges, top)
    value = rng.uniform(ends[low], ends[high])
    return int(np.clip(np.searchsorted(ends, value, "right") - 1, low, high - 1))


def fit_forest(df: DataFrame, label: str, params: Forest, weight: str | None = None) -> TreeModel:
    """A forest; the trees of a group that fits into memory grow together, a pass per level."""
    edges = feature_edges(df)
    rows = binned_rows(df, label, edges, weight)
    trees = grow(rows, edges, greatest(df, len(edges)), [Job(params, t) for t in range(params.n_estimators)])
    return TreeModel(edges, trees, False)


def greatest(df: DataFrame, features: int) -> np.ndarray:
    """The greatest value of every feature."""
    x = df.select(vector_to_array("features").alias("x"))
    return np.array(x.agg(*[F.max(F.col("x")[k]) for k in range(features)]).first(), float)


@dataclass(frozen=True)
class Job:
    """A tree to grow: the forest that it belongs to, its number there, and the fold that it does not read."""

    params: Forest
    number: int
    fold: int | None = None

    def deepest(self) -> int:
        p = self.params
        return p.max_depth if p.max_leaf_nodes is None else min(p.max_depth, p.max_leaf_nodes - 1)


def grow(rows: DataFrame, edges: list[np.ndarray], tops: np.ndarray, jobs: list[Job], expanding: bool = False) -> list[Tree]:
    """All trees, of whatever forests and folds, level by level over one binned table.

    A tree reads the rows of other folds than its own, or with ``expanding`` only those of earlier folds.
    """
    width, d = max((len(e) for e in edges), default=0) + 1, len(edges)
    trees = [Tree() for _ in jobs]
    levels = {t: [tree.add()] for t, tree in enumerate(trees)}
    rngs = [np.random.default_rng([SEED, j.number]) for j in jobs]
    depth = 0
    while any(levels.values()):
        waiting = [(t, node) for t, level in levels.items() for node in level]
        levels = {t: [] for t in range(len(trees))}
        most = max(1, MOST_SUMS // (d * width * 2))
        for at in range(0, len(waiting), most):
            part = waiting[at : at + most]
            for (t, node), own in zip(part, _forest_sums(rows, trees, part, jobs, expanding, d, width)):
                ones, n = own[0].sum(0)
                if not depth:
                    trees[t].value[node] = float(ones / n) if n else 0.5
                if depth < jobs[t].deepest() and 0 < ones < n:
                    gain, k, b = jobs[t].params.splits(own, edges, tops, rngs[t])
                    if gain > 0:
                        pair = trees[t].split(node, k, b, gain)
                        for child, (a, m) in zip(pair, (own[k, : b + 1].sum(0), own[k, b + 1 :].sum(0))):
                            trees[t].value[child] = float(a / m)
                        # the children of the last level are leaves
                        levels[t] += pair if depth + 1 < jobs[t].deepest() else ()
        depth += 1
    return [t if j.params.max_leaf_nodes is None else t.capped(j.params.max_leaf_nodes) for t, j in zip(trees, jobs)]


def _forest_sums(rows: DataFrame, trees: list[Tree], part: list[tuple[int, int]], jobs: list[Job], expanding: bool, d: int, width: int) -> np.ndarray:
    wanted: dict[int, list[tuple[int, int]]] = {}
    for place, (t, node) in enumerate(part):
        wanted.setdefault(t, []).append((node, place))
    growing = {t: trees[t] for t in wanted}
    ways = {t: (jobs[t].number, jobs[t].fold, jobs[t].params.bootstrap) for t in wanted}

    def add(total, batch):
        r = _read(batch)
        for t, own in wanted.items():
            number, fold, replace = ways[t]
            place = np.full(len(growing[t].left), -1)
            for k, (node, _) in enumerate(own):
                place[node] = k
            w = sampled(r.draw, r.w, number, 1.0, replace)
            if fold is not None:
                w = w * (r.fold < fold if expanding else r.fold != fold)
            node = np.where(w > 0, place[growing[t].nodes(r.bins)], -1)
            total[[p for _, p in own]] += _histograms(r, node, w * r.y, w, len(own), width).reshape(len(own), -1)

    return summed(rows, len(part), d * width * 2, add).reshape(len(part), d, width, 2)


def forest_hits(rows: DataFrame, forests: list[list[Tree]], folds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(weight of rows, weight classified right) of every forest on its fold, in one pass."""

    def add(total, batch):
        r = _read(batch)
        for k, (trees, fold) in enumerate(zip(forests, folds)):
            mine = r.fold == fold
            p = sum((t.values(r.bins[mine]) for t in trees), np.zeros(int(mine.sum()))) / max(1, len(trees))
            total[k, 0] += r.w[mine].sum()
            total[k, 1] += r.w[mine] @ ((p > 0.5) == (r.y[mine] > 0.5))

    sums = summed(rows, len(forests), 2, add)
    return sums[:, 0], sums[:, 1]


def search_forests(
    df: DataFrame,
    label: str,
    candidates: list[Forest],
    fold_column: str = "fold",
    folds: int = 5,
    expanding: bool = False,
    first: int | None = None,
    share: float = 0.25,
) -> list[dict]:
    """Accuracy of every candidate on every fold, all forests growing together over one binned copy of the rows.

    With ``first`` the search is cut by successive halving: all candidates get so many trees, then the best ``share``
    of them 1 / ``share`` times as many, until what is left has all its trees. A candidate's scores are those of the
    last round that it was in; ``trees`` says how many it had, ``last`` which round it was.
    """
    edges = feature_edges(df)
    rows, tops = binned_rows(df, label, edges, fold=fold_column), greatest(df, len(edges))
    grown: dict[tuple[int, int], list[Tree]] = {(c, f): [] for c in range(len(candidates)) for f in range(folds)}
    left, size, scores, turn = list(range(len(candidates))), first, {}, 0
    while left:
        wanted = {c: candidates[c].n_estimators if size is None else min(size, candidates[c].n_estimators) for c in left}
        work = [(c, f, t) for c in left for f in range(folds) for t in range(len(grown[c, f]), wanted[c])]
        for (c, f, _), tree in zip(work, grow(rows, edges, tops, [Job(candidates[c], t, f) for c, f, t in work], expanding)):
            grown[c, f].append(tree)
        pairs = [(c, f) for c in left for f in range(folds)]
        for (c, f), tested, right in zip(pairs, *forest_hits(rows, [grown[p] for p in pairs], [f for _, f in pairs])):
            scores[c, f] = {"candidate": c, "fold": f, "score": float(right / tested) if tested else 0.0, "tested": int(tested), "right": int(right), "trees": wanted[c], "last": turn}
        turn += 1
        if size is None or all(wanted[c] == candidates[c].n_estimators for c in left):
            break
        mean = {c: np.mean([scores[c, f]["score"] for f in range(folds)]) for c in left}
        left = sorted(sorted(left, key=lambda c: (-mean[c], c))[: max(1, math.ceil(len(left) * share))])
        size = math.ceil(size / share)
    return [scores[k] for k in sorted(scores)]


def winner(scores: list[dict]) -> int:
    """The best candidate among those in the last round, the earliest on ties."""
    rounds: dict[int, list[dict]] = {}
    for s in scores:
        rounds.setdefault(s["candidate"], []).append(s)
    return max(rounds, key=lambda c: (rounds[c][0]["last"], np.mean([s["score"] for s in rounds[c]]), -c))


# --- estimators with the names of the search ranges -------------------------------------------------


class TreeEstimator:
    """``fit`` of a booster or forest on rows with a feature vector."""

    def __init__(self, label: str, params: Boosting | Forest, weight: str | None = None, validation: str | None = None):
        self.label, self.params, self.weight, self.validation = label, params, weight, validation

    def fit(self, df: DataFrame) -> TreeModel:
        if isinstance(self.params, Boosting):
            return fit_boosting(df, self.label, self.params, self.weight, self.validation)
        return fit_forest(df, self.label, self.params, self.weight)
