"""From order lines to ranked suggestions for every customer's next order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import product_label, suggestion_line, whole
from ..learning.models import bounded, patient_boosting, score, spread, weighted_boosting
from ..learning.search import PURCHASE_RANGES, best_of, sample
from ..operators import baskets as B
from ..operators import cells as G
from ..operators import metrics as V
from ..operators.joins import lookup
from ..operators.keys import join_same, measured
from ..operators.splits import split_by_time, time_series_folds
from ..session import cut_lineage
from ..sources.files import write_csv, write_lines

LINES = B.LineColumns()
FEATURES = ["month", "day_of_week", "days_since_last_order", "lag1", "lag2", "category_rate"]


@dataclass(frozen=True)
class History:
    """What the models read: baskets, order positions, calendar features, lags, the categories."""

    basket: DataFrame
    sequence: DataFrame
    features: DataFrame
    entries: DataFrame
    categories: DataFrame
    target_offset: int


def build_history(
    lines: DataFrame,
    dim: DataFrame,
    c: B.LineColumns = LINES,
    delete_not_found: bool = False,
    by_order_id: bool = False,
    target_offset: int = 1,
    categories: DataFrame | None = None,
    trim: bool = True,
    served: bool = False,
) -> History:
    """Read the lines once: the (order, category) totals are written and everything else derives from them.

    Categories are those that occur unless a table of them is given. With ``served`` the basket is written with its
    positions, which both the lags and the cells to serve read.
    """
    known = B.apply_categories(lines, dim, c, delete_not_found)
    cells = cut_lineage(
        known.groupBy(c.customer, c.order, c.category).agg(
            whole(F.sum(c.amount)).alias(c.amount), F.min(c.day).alias(c.day)
        ),
        "cells",
    )
    basket = cells.where(F.col(c.category).isNotNull()).drop(c.day)
    sequence = cut_lineage(B.sequence_orders(B.order_days(cells, c), c, by_order_id), "sequence")
    if served:
        basket = cut_lineage(B.placed_basket(basket, sequence, c), "basket")
    return History(
        basket,
        sequence,
        B.order_features(sequence, c),
        B.lag_entries(basket, sequence, c, target_offset, trim),
        cut_lineage(B.category_table(basket, c), "categories") if categories is None else categories,
        target_offset,
    )


@dataclass(frozen=True)
class TrainingSet:
    """What the pooled model learns from: ``orders`` with role, fold and calendar, the sparse ``entries`` with those of
    their order, the level of every category's rate, and the weighted ``cells`` with their feature vectors."""

    orders: DataFrame
    entries: DataFrame
    rates: DataFrame
    cells: DataFrame

    def grid(self, role: str, c: B.LineColumns = LINES) -> G.Grid:
        """The cells of the orders with that role, to be scored."""
        orders, entries, cells = (x.where(F.col("role") == role) for x in (self.orders, self.entries, self.cells))
        return G.open_grid(orders, entries, self.rates, (), c, counted=cells.select(*FEATURES, "target", "weight"))


def assembled(df: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df)


def training_set(h: History, c: B.LineColumns = LINES, test_size: float = 0.1, val_size: float = 0.2) -> TrainingSet:
    """Weighted cells with role and features, written once for all fits; no row per order and category is made."""
    placed = split_by_time(h.features, h.sequence, c, test_size, val_size, h.target_offset)
    placed = cut_lineage(time_series_folds(placed, "place", "n_train"), "placed")
    entries = cut_lineage(G.placed_entries(placed, h.entries, ["role", "test_fold"], c), "entries")
    train = F.col("role") == "train"
    rates = cut_lineage(G.category_levels(h.categories, entries.where(train), placed.where(train), c), "rates")
    cells = assembled(G.training_cells(placed, entries, rates, ["role"], c))
    return TrainingSet(placed, entries, rates, cut_lineage(cells.withColumn("is_val", F.col("role") == "val"), "training"))


def model_scorer(model, names: Sequence[str] = FEATURES) -> G.Scorer:
    """The model as a function that adds ``probability`` to rows of calendar, lags and level."""
    return lambda cells: score(model, assembled(cells, names)).drop("features", "prediction")


def search_parameters(
    t: TrainingSet, h: History, c: B.LineColumns = LINES, n_iter: int = 20, folds: int = 5, trees: int = 100, parallelism: int = 4,
    max_fit_rows: int | None = None,
) -> tuple[dict, list[dict]]:
    """Random search on the most bought tenth of the categories, over expanding time folds of the training part.

    ``max_fit_rows`` bounds the weighted cells that a fit reads, about; every cell of a fold is scored.
    """
    top = measured(B.top_categories(h.entries, h.categories, c).select(c.category))
    orders = t.orders.where(F.col("role") == "train")
    # the rate of a category is learned on the whole training part, so it would tell a fold what comes after it
    rates = top.withColumn(G.LEVEL, F.lit(0.0))
    names = [f for f in FEATURES if f != G.LEVEL]
    entries = t.entries.where(F.col("role") == "train")
    entries = cut_lineage(join_same(entries, top, [c.category], "left_semi"), "searched")
    cells = G.training_cells(orders, entries, rates, ["test_fold"], c)
    if max_fit_rows is not None:
        cells = bounded(cells, max_fit_rows, "test_fold", *G.CALENDAR, "lag1", "lag2", "target")
    cells = cut_lineage(assembled(cells, names), "searched")
    grid = G.open_grid(orders, entries, rates, ["test_fold"], c)
    candidates = sample(PURCHASE_RANGES, n_iter)
    work = [(k, fold) for k in range(n_iter) for fold in range(folds)]

    def one(item: tuple[int, int]) -> dict:
        k, fold = item
        train = cells.where(F.col("test_fold") < fold)
        model = weighted_boosting(train, "target", "weight", n_estimators=trees, **candidates[k]).fit(spread(train, "weight"))
        scored = grid.where(f"test_fold = {fold}").scored(model_scorer(model, names))
        f1 = V.weigh_f1(G.category_f1(scored, V.DEFAULT_THRESHOLD)).first()[0]
        return {"candidate": k, "fold": fold, "score": float(f1)}

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        scores = list(pool.map(one, work))
    return candidates[best_of(scores)], scores


def fit_pooled(t: TrainingSet, params: dict, trees: int = 1000, patience: int = 20, max_fit_rows: int | None = None):
    """One model for all categories, with as many trees as the validation rows speak for.

    ``max_fit_rows`` bounds the weighted cells used to fit, about; every cell is still scored.
    """
    fitted = t.cells.where(F.col("role").isin("train", "val"))
    if max_fit_rows is not None:
        fitted = bounded(fitted, max_fit_rows, "role", *FEATURES, "target")
    return patient_boosting(fitted, "target", "is_val", trees, patience, params, weight="weight")


def tuned_threshold(scored: G.ScoredCells) -> float:
    """Threshold at which the validation orders get as many categories as they bought on average."""
    return V.best_threshold(G.threshold_curve_of(scored)).first()["threshold"]


def evaluate(scored: G.ScoredCells, threshold: float | Column) -> DataFrame:
    """Sample-averaged F1, Jaccard and basket widths of the orders at a threshold."""
    return V.mean_scores(G.unit_scores(scored, threshold))


@dataclass(frozen=True)
class Serving:
    """Each customer's next order: ``heads`` with the calendar, ``own`` cells of the last two baskets, the levels."""

    heads: DataFrame
    own: DataFrame
    rates: DataFrame


def serving(h: History, t: TrainingSet, today: dt.date, c: B.LineColumns = LINES) -> Serving:
    heads = cut_lineage(G.serving_heads(h.sequence, today, c), "heads")
    return Serving(heads, cut_lineage(G.serving_cells(h.basket, h.sequence, c), "own"), t.rates)


def suggest(
    served: Serving, score: G.Scorer, threshold: float | Column, h: History, products: DataFrame, c: B.LineColumns = LINES, n_to_show: int | None = None
) -> DataFrame:
    """Ranked categories per customer with three example products each."""
    show = B.basket_width(h.basket, h.sequence, c)
    if n_to_show is not None:
        show = show.withColumn("n_to_show", F.lit(n_to_show))
    ranked = G.merged_suggestions(served.heads, served.own, served.rates, score, threshold, show, c)
    return with_examples(ranked, products, c)


def with_examples(ranked: DataFrame, products: DataFrame, c: B.LineColumns = LINES) -> DataFrame:
    """Three example products beside each suggested category."""
    examples = B.category_examples(products, c)
    return lookup(ranked, examples, c.category, c.category, {k: k for k in examples.columns if k != c.category})


def report_lines(suggested: DataFrame, heads: DataFrame, predicted: DataFrame | None = None, c: B.LineColumns = LINES) -> DataFrame:
    """Text lines per customer: when they last ordered, how many of the categories predicted are shown, then one
    line per suggested category. ``predicted`` has ``n_predicted`` per customer."""
    labels = [product_label(f"example_{i}", f"id_product_{i}") for i in (1, 2, 3)]
    rows = suggested.select(c.customer, "rank", suggestion_line("probability", *labels).alias("line"))
    heads = heads.select(c.customer, "last_day", "days_since_last_order").distinct()
    head = F.format_string(
        "Last order : %s  (%d days ago)", F.col("last_day").cast("string"), F.col("days_since_last_order")
    )
    first = heads.select(c.customer, F.lit(0).alias("rank"), head.alias("line"))
    if predicted is None:
        return first.unionByName(rows)
    shown = suggested.groupBy(c.customer).agg(F.count(F.lit(1)).alias("_shown"))
    met = join_same(join_same(heads.select(c.customer), predicted, [c.customer]), shown, [c.customer])
    line = F.format_string(
        "Showing top %d categories, out of %d predicted", F.coalesce("_shown", F.lit(0)), F.coalesce("n_predicted", F.lit(0))
    )
    return first.unionByName(met.select(c.customer, F.lit(0).alias("rank"), line.alias("line"))).unionByName(rows)


def compare_thresholds(t: TrainingSet, model, c: B.LineColumns = LINES) -> DataFrame:
    """Scores of the test orders at the default threshold and at the one tuned on the validation orders."""
    threshold = tuned_threshold(t.grid("val", c).scored(model_scorer(model)))
    tested = t.grid("test", c).scored(model_scorer(model))
    default = evaluate(tested, V.DEFAULT_THRESHOLD).withColumn("threshold", F.lit(V.DEFAULT_THRESHOLD))
    return default.unionByName(evaluate(tested, threshold).withColumn("threshold", F.lit(threshold)))


def write_suggestions(suggested: DataFrame, lines: DataFrame, table_path: str, text_path: str, c: B.LineColumns = LINES) -> None:
    """The suggestion table as CSV and the text report, customer by customer in order of rank."""
    write_csv(suggested, table_path)
    write_lines(lines, text_path, "line", [c.customer, "rank", "line"])


def next_purchases(
    lines: DataFrame,
    dim: DataFrame,
    today: dt.date,
    c: B.LineColumns = LINES,
    n_iter: int = 20,
    trees: int = 1000,
    search_trees: int = 100,
    params: dict | None = None,
    delete_not_found: bool = False,
    n_to_show: int | None = None,
) -> DataFrame:
    """The whole job: history, search, pooled model, tuned threshold, ranked suggestions; every fit reads all its rows.

    ``params`` skips the search.
    """
    h = build_history(lines, dim, c, delete_not_found, served=True)
    products = dim.where(F.col(c.category).isNotNull())
    return purchases_of(h, products, today, c, n_iter, trees, search_trees, params, n_to_show)


def purchases_of(
    h: History,
    products: DataFrame,
    today: dt.date,
    c: B.LineColumns = LINES,
    n_iter: int = 20,
    trees: int = 1000,
    search_trees: int = 100,
    params: dict | None = None,
    n_to_show: int | None = None,
) -> DataFrame:
    """The job from a history on: search, pooled model, tuned threshold, ranked suggestions."""
    t = training_set(h, c, test_size=0.0)
    if params is None:
        params, _ = search_parameters(t, h, c, n_iter, trees=search_trees)
    score = model_scorer(fit_pooled(t, params, trees))
    threshold = tuned_threshold(t.grid("val", c).scored(score))
    return suggest(serving(h, t, today, c), score, threshold, h, products, c, n_to_show)
