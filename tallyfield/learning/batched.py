"""Many logistic models in one pass: every round sums the gradients and curvatures of all of them at once.

``fit_grid`` fits models that read the same rows and differ in penalty and fold, as a search does: tasks sum over
their rows for all models together, and the sums, whose size depends on models and features alone, are solved on the
driver. ``fit_keyed`` fits one model per key, however many keys there are: rows meet their key's coefficients in a
join, sums are made per key, and the models stay a table.

Both take Newton steps with an elastic-net penalty on the mean loss (the intercept is free), and halve a step that
made the objective worse.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import join_same
from ..session import cut_lineage
from .models import ELASTIC_SHARE
from .reduce import PART, summed

#: Features with curvature at most, and sweeps over the coefficients within a step.
WIDEST, SWEEPS = 256, 200
TOLERANCE = 1e-7


@dataclass(frozen=True)
class Penalised:
    """A model of a grid: penalties of the mean loss, and the fold it leaves out (None: it reads all rows)."""

    l1: float
    l2: float
    fold: int | None = None


def penalties(model: str, rows: int, params: dict) -> tuple[float, float]:
    """(l1, l2) of the linear classifiers by their parameter names; ``C`` is the inverse penalty of the summed loss."""
    if model == "logistic":
        strength = 1.0 / (max(rows, 1) * params.get("C", 1.0))
    else:
        strength = params.get("alpha", 0.01)
    share = {"l2": 0.0, "l1": 1.0, "elasticnet": ELASTIC_SHARE}[params.get("penalty", "l2")]
    return strength * share, strength * (1 - share)


def _pairs(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _losses(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log loss, probability) of margins."""
    return np.logaddexp(0, z) - y * z, 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _row_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Per model: weight, loss, gradient and upper curvature, summed over rows that all models read."""
    z = x @ theta.T
    loss, p = _losses(z, y[:, None])
    i, j = _pairs(x.shape[1])
    slope, bend = (p - y[:, None]) * w[:, None], p * (1 - p) * w[:, None]
    return np.hstack([np.full((len(theta), 1), w.sum()), (w @ loss)[:, None], slope.T @ x, bend.T @ (x[:, i] * x[:, j])])


class Newton:
    """State of many models between rounds: coefficients, the step being tried, and what it must not exceed."""

    def __init__(self, theta: np.ndarray, l1: np.ndarray, l2: np.ndarray):
        self.theta, self.l1, self.l2 = theta, l1, l2
        n, d = theta.shape
        self.direction, self.step = np.zeros((n, d)), np.ones(n)
        self.best, self.done = np.full(n, np.inf), np.zeros(n, bool)

    def tried(self) -> np.ndarray:
        return self.theta + self.step[:, None] * self.direction

    def advance(self, sums: np.ndarray) -> None:
        """Take the sums at what was tried: keep it and find the next direction, or halve the step."""
        d = self.theta.shape[1]
        total = np.maximum(sums[:, :1], 1e-300)
        loss, slope, bend = sums[:, 1] / total[:, 0], sums[:, 2 : 2 + d] / total, sums[:, 2 + d :] / total
        at = self.tried()
        free = at[:, 1:]
        value = loss + self.l1 * np.abs(free).sum(1) + self.l2 / 2 * (free**2).sum(1)
        better = value <= self.best + 1e-12 * np.abs(self.best)
        worse = ~better & ~self.done
        self.step[worse] /= 2
        self.done |= worse & (self.step < 1e-6)
        take = np.flatnonzero(better & ~self.done)
        self.theta[take], self.best[take], self.step[take] = at[take], value[take], 1.0
        if len(take):
            self.direction[take] = self._directions(at[take], slope[take], bend[take], self.l1[take], self.l2[take])
            still = np.abs(self.direction[take]).max(1) < TOLERANCE * (1 + np.abs(at[take]).max(1))
            self.done[take[still]] = True
        self.direction[self.done] = 0

    @staticmethod
    def _directions(theta, slope, bend, l1, l2) -> np.ndarray:
        n, d = theta.shape
        i, j = _pairs(d)
        h = np.zeros((n, d, d))
        h[:, i, j] = h[:, j, i] = bend
        penalised = np.ones(d)
        penalised[0] = 0
        h[:, range(d), range(d)] += l2[:, None] * penalised + 1e-9
        g = slope + l2[:, None] * theta * penalised
        out = np.zeros((n, d))
        plain = l1 == 0
        if plain.any():
            out[plain] = -np.linalg.solve(h[plain], g[plain][..., None])[..., 0]
        rest = np.flatnonzero(~plain)
        if len(rest):
            h, g, theta, l1 = h[rest], g[rest], theta[rest], l1[rest]
            step, pull = np.zeros((len(rest), d)), np.zeros((len(rest), d))  # pull: h @ step
            for _ in range(SWEEPS):
                moved = 0.0
                for k in range(d):
                    bend_k = h[:, k, k]
                    now = theta[:, k] + step[:, k]
                    want = now - (g[:, k] + pull[:, k]) / bend_k
                    if k:
                        want = np.sign(want) * np.maximum(np.abs(want) - l1 / bend_k, 0)
                    change = want - now
                    step[:, k] += change
                    pull += h[:, :, k] * change[:, None]
                    moved = max(moved, float(np.abs(change).max()))
                if moved < TOLERANCE / 10:
                    break
            out[rest] = step
        return out


def grid_rows(df: DataFrame, label: str, fold_column: str | None = None, weight: str | None = None) -> DataFrame:
    """(x, y, w, fold) of rows with a feature vector, written once for all rounds."""
    return cut_lineage(
        df.select(
            vector_to_array("features").alias("x"),
            F.col(label).cast("double").alias("y"),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
            (F.col(fold_column) if fold_column else F.lit(-1)).cast("int").alias("fold"),
        ),
        "grid",
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length with a 1 before them."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.hstack([np.ones((len(x), 1)), x])


def _by_fold(models: Sequence[Penalised]) -> dict[int | None, np.ndarray]:
    folds = {m.fold for m in models}
    return {f: np.array([k for k, m in enumerate(models) if m.fold == f]) for f in folds}


def fit_grid(rows: DataFrame, models: Sequence[Penalised], expanding: bool = False, rounds: int = 60) -> np.ndarray:
    """Coefficients, intercept first, of every model over ``grid_rows``.

    A model reads the rows of other folds than its own, or with ``expanding`` only those of earlier folds. One pass a
    round for all models.
    """
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d = first[0] + 1
    if d > WIDEST:
        raise ValueError(f"{d} features: curvatures are summed for up to {WIDEST}")
    groups = _by_fold(models)
    state = Newton(np.zeros((len(models), d)), *(np.array([getattr(m, k) for m in models], float) for k in ("l1", "l2")))
    width = 2 + d + d * (d + 1) // 2
    for _ in range(rounds):
        theta, open_ = state.tried(), ~state.done

        def add(total, batch, theta=theta, open_=open_):
            x, y, w, fold = _matrix(batch.column(0)), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for f, own in groups.items():
                own = own[open_[own]]
                read = slice(None) if f is None else fold < f if expanding else fold != f
                if len(own) and len(y[read]):
                    total[own] += _row_sums(x[read], y[read], w[read], theta[own])

        sums = summed(rows, len(models), width, add)
        sums[state.done] = 0
        sums[state.done, 0] = 1
        state.advance(sums)
        if state.done.all():
            break
    return state.theta


def grid_hits(rows: DataFrame, models: Sequence[Penalised], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of rows, weight of rows classified right) on each model's own fold; all models in one pass."""
    groups = _by_fold(models)

    def add(total, batch):
        x, y, w, fold = _matrix(batch.column(0)), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        for f, own in groups.items():
            read = slice(None) if f is None else fold == f
            right = (x[read] @ theta[own].T > 0) == (y[read, None] > 0.5)
            total[own, 0] += w[read].sum()
            total[own, 1] += w[read] @ right

    sums = summed(rows, len(models), 2, add)
    return sums[:, 0], sums[:, 1]


def grid_search(
    df: DataFrame, model: str, label: str, rows: int, candidates: Sequence[dict], fold_column: str = "fold", folds: int = 5, expanding: bool = False
) -> list[dict]:
    """Accuracy of every candidate of a linear classifier on every fold, with rows tested and rows right."""
    data = grid_rows(df, label, fold_column)
    work = [(c, f) for c in range(len(candidates)) for f in range(folds)]
    models = [Penalised(*penalties(model, rows, candidates[c]), f) for c, f in work]
    tested, right = grid_hits(data, models, fit_grid(data, models, expanding))
    return [
        {"candidate": c, "fold": f, "score": float(r / t) if t else 0.0, "tested": int(t), "right": int(r)}
        for (c, f), t, r in zip(work, tested, right)
    ]


# --- one model per key ------------------------------------------------------------------------------


def fit_keyed(rows: DataFrame, key: str, shared: DataFrame | None = None, l2: float = 1e-4, rounds: int = 60) -> DataFrame:
    """(key, theta) from rows (key, x, y, w), ``x`` without the intercept.

    ``shared`` rows (x, w) count for every key with label 0; their number must not grow with the data, for every task
    holds them. Rows of negative weight take back what the shared rows say of the key too much.
    """
    first = rows.select(F.size("x")).first()
    if first is None:
        return rows.select(key, F.array(F.lit(0.0)).alias("theta")).limit(0)
    d = first[0] + 1
    width = 2 + d + d * (d + 1) // 2
    names = [f"s{k}" for k in range(width)]
    held = [tuple(r) for r in shared.select("x", "w").collect()] if shared is not None else []
    x_shared = np.hstack([np.ones((len(held), 1)), np.array([r[0] for r in held], float).reshape(len(held), d - 1)])
    w_shared = np.array([r[1] for r in held], float)
    rows = cut_lineage(rows.select(F.col(key).alias("key"), "x", "y", "w"), "keyed")
    kind = rows.schema["key"].dataType.simpleString()
    sums_of = f"key {kind}, " + ", ".join(f"{n} double" for n in names)
    state_of = f"key {kind}, theta array<double>, direction array<double>, step double, best double, done boolean"

    def partial(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                keys = part.column(0).dictionary_encode()
                x, y, w = _matrix(part.column(1)), *(part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                theta = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(x), d)
                loss, p = _losses((x * theta).sum(1), y)
                i, j = _pairs(d)
                each = np.hstack([w[:, None], (w * loss)[:, None], x * (w * (p - y))[:, None], x[:, i] * x[:, j] * (w * p * (1 - p))[:, None]])
                codes = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                begins = np.flatnonzero(np.diff(codes[order], prepend=-1))
                sums = np.add.reduceat(each[order], begins, axis=0)
                own = part.column(0).take(pa.array(order[begins]))
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, sums.T)], names=["key", *names])

    def update(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                theta, direction = (part.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, d).copy() for k in (1, 2))
                state = Newton(theta, np.zeros(n), np.full(n, l2))
                state.direction = direction
                state.step, state.best = (part.column(k).to_numpy(zero_copy_only=False).copy() for k in (3, 4))
                state.done = part.column(5).to_numpy(zero_copy_only=False).copy()
                sums = np.stack([part.column(6 + k).to_numpy(zero_copy_only=False) for k in range(width)], 1)
                for lo in range(0, len(x_shared), PART):
                    cut = slice(lo, lo + PART)
                    sums = sums + _row_sums(x_shared[cut], np.zeros(len(x_shared[cut])), w_shared[cut], state.tried())
                state.advance(sums)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": part.column(0),
                        "theta": pa.array(list(state.theta), pa.list_(pa.float64())),
                        "direction": pa.array(list(state.direction), pa.list_(pa.float64())),
                        "step": state.step,
                        "best": state.best,
                        "done": state.done,
                    }
                )

    zeros = F.array_repeat(F.lit(0.0), d)
    state = rows.select("key").distinct().select("key", zeros.alias("theta"), zeros.alias("direction"), F.lit(1.0).alias("step"), F.lit(float("inf")).alias("best"), F.lit(False).alias("done"))
    state = cut_lineage(state, "models")
    tried = F.zip_with("theta", "direction", lambda t, s: t + s * F.col("step")).alias("tried")
    for _ in range(rounds):
        going = state.where(~F.col("done"))
        if going.isEmpty():
            break
        met = join_same(rows, going.select("key", tried), ["key"], "inner").select("key", "x", "y", "w", "tried")
        sums = met.mapInArrow(partial, sums_of).groupBy("key").agg(*[F.sum(n).alias(n) for n in names])
        stepped = join_same(going, sums, ["key"], "inner").mapInArrow(update, state_of)
        state = cut_lineage(stepped.unionByName(state.where("done")), "models")
    return state.select(F.col("key").alias(key), "theta")


def keyed_probability(theta: str, x: Sequence[Column]) -> Column:
    """Probability by the coefficients of a row's key, intercept first."""
    z = F.col(theta)[0]
    for k, value in enumerate(x):
        z = z + F.col(theta)[k + 1] * value
    return 1 / (1 + F.exp(-z))
