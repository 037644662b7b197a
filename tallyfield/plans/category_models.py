"""One purchase model per category, all fitted in one pass a round, however many categories there are.

A category's model reads the calendar of an order and what the last two baskets held of the category. Nearly all
cells of a category are absent; they differ by calendar only, of which there are at most 30,828 (a year's gap counts
like any longer one). So every model reads the calendars of all orders as never bought, and its present cells, each
with a row of weight -1 that takes its calendar's share back. Models are a table; scores come from a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..learning.batched import fit_keyed, keyed_probability
from ..operators import cells as G
from ..operators import metrics as V
from ..operators.baskets import LineColumns
from ..operators.keys import join_same, measured
from ..session import cut_lineage

LINES = LineColumns()
#: Days since the last order beyond which a gap counts the same.
LONGEST_GAP = 366


def _gap() -> Column:
    return F.least("days_since_last_order", F.lit(LONGEST_GAP))


def features(lag1: Column, lag2: Column) -> list[Column]:
    """What a category's model reads of a cell."""
    had = [F.when(k > 0, 1.0).otherwise(0.0) for k in (lag1, lag2)]
    amount = [F.log1p(F.greatest(k, F.lit(0)).cast("double")) for k in (lag1, lag2)]
    return [F.col("month") / 12, F.col("day_of_week") / 6, F.col("days_since_last_order") / 30, *had, *amount]


def _clipped(df: DataFrame) -> DataFrame:
    return df.withColumn("days_since_last_order", _gap())


def calendars(orders: DataFrame) -> DataFrame:
    """(calendar, n_orders), at most 12 x 7 x 367 rows."""
    return _clipped(orders).groupBy(*G.CALENDAR).agg(F.count(F.lit(1)).alias("n_orders"))


def fit_category_models(orders: DataFrame, entries: DataFrame, c: LineColumns = LINES, l2: float = 1e-4) -> DataFrame:
    """(category, theta) of every category with an entry among the orders."""
    zero = F.lit(0)
    shared = calendars(orders).select(F.array(*features(zero, zero)).alias("x"), F.col("n_orders").cast("double").alias("w"))
    held = join_same(entries, _clipped(orders).select(c.customer, "seq", *G.CALENDAR), [c.customer, "seq"], "inner")
    # written, since it is read three times: for the rows, for what they take back and for the number of features
    cells = cut_lineage(held.groupBy(c.category, *G.CALENDAR, "lag1", "lag2", "target").agg(F.count(F.lit(1)).cast("double").alias("w")), "counted")
    rows = cells.select(c.category, F.array(*features(F.col("lag1"), F.col("lag2"))).alias("x"), F.col("target").cast("double").alias("y"), "w")
    back = cells.groupBy(c.category, *G.CALENDAR).agg((-F.sum("w")).alias("w"))
    back = back.select(c.category, F.array(*features(zero, zero)).alias("x"), F.lit(0.0).alias("y"), "w")
    return fit_keyed(rows.unionByName(back), c.category, shared, l2)


@dataclass(frozen=True)
class ScoredByCategory:
    """Scores of all orders and categories: the cells with an entry as rows, the others by model and calendar."""

    orders: DataFrame
    present: DataFrame
    models: DataFrame
    calendars: DataFrame
    columns: LineColumns


def score_categories(models: DataFrame, orders: DataFrame, entries: DataFrame, c: LineColumns = LINES) -> ScoredByCategory:
    """Probability of every cell; a category without a model is never predicted."""
    orders = _clipped(orders)
    held = join_same(entries, orders, [c.customer, "seq"], "inner")
    met = join_same(held, measured(models), [c.category])
    zero = F.lit(0)
    scores = {
        "probability": F.coalesce(keyed_probability("theta", features(F.col("lag1"), F.col("lag2"))), F.lit(0.0)),
        "if_absent": F.coalesce(keyed_probability("theta", features(zero, zero)), F.lit(0.0)),
    }
    return ScoredByCategory(orders, cut_lineage(met.withColumns(scores).drop("theta"), "present"), models, cut_lineage(calendars(orders), "calendars"), c)


def _over_absent(s: ScoredByCategory, schema: str, work: Callable[[pa.Array, np.ndarray, np.ndarray], dict]) -> DataFrame:
    """``work(categories, probabilities, orders)`` over batches of models: one column of probabilities per calendar."""
    zero = F.lit(0)
    # a bounded number of calendars
    rows = s.calendars.sort(*G.CALENDAR).select(F.array(*features(zero, zero)), "n_orders").collect()
    x = np.hstack([np.ones((len(rows), 1)), np.array([r[0] for r in rows], float).reshape(len(rows), len(features(zero, zero)))])
    n = np.array([r[1] for r in rows], np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                theta = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(theta @ x.T, -500, 500)))
                yield pa.RecordBatch.from_pydict(work(part.column(0), p, n))

    models = s.models.select(s.columns.category, "theta") if rows else s.models.select(s.columns.category, "theta").limit(0)
    return models.mapInArrow(run, schema)


def threshold_curve_of(s: ScoredByCategory) -> DataFrame:
    """The threshold curve over all cells of the grid."""
    steps = np.array(V.THRESHOLDS)

    def levels(_, p, n):
        at = np.searchsorted(steps, p, "right") - 1
        counts = np.bincount((at + 1).ravel(), np.broadcast_to(n, p.shape).ravel(), len(steps) + 1)
        return {"_level": pa.array(np.arange(-1, len(steps)), pa.int32()), "_c": pa.array(counts.astype(np.int64))}

    one = F.lit(1).cast("bigint")
    own = s.present.select(V.score_level("probability").alias("_level"), one.alias("_c"))
    instead = s.present.select(V.score_level("if_absent").alias("_level"), (-one).alias("_c"))
    all_absent = _over_absent(s, "_level int, _c bigint", levels)
    counts = all_absent.union(own).union(instead).groupBy("_level").agg(F.sum("_c").alias("_c"))
    base = s.present.agg(F.count_if(F.col("target") > 0).alias("bought"))
    return V.cumulated_curve(counts, s.orders.agg(F.count(F.lit(1)).alias("orders")), base)


def unit_scores(s: ScoredByCategory, threshold: float) -> DataFrame:
    """tp, fp, fn, F1 and Jaccard of every order over all categories."""
    c = s.columns

    def widths(_, p, n):
        return {"place": pa.array(np.arange(len(n)), pa.int32()), "_absent": pa.array((p >= threshold).sum(0).astype(np.int64))}

    hits = _over_absent(s, "place int, _absent bigint", widths).groupBy("place").agg(F.sum("_absent").alias("_absent"))
    # the calendars in the order in which their probabilities stand
    listed = s.calendars.agg(F.sort_array(F.collect_list(F.struct(*G.CALENDAR))).alias("_all")).select(F.posexplode("_all").alias("place", "_c"))
    absent = join_same(listed.select("place", "_c.*"), hits, ["place"], "inner").drop("place")
    rows = join_same(s.orders.select(c.customer, c.order, *G.CALENDAR), measured(absent), G.CALENDAR)
    rows = join_same(rows, G.own_hits(s.present, [c.customer, c.order], threshold), [c.customer, c.order])
    return G.with_absent(rows, [c.customer, c.order]).withColumns({"f1": V.f1_ratio(), "jaccard": V.jaccard_ratio()})


def category_f1(s: ScoredByCategory, threshold: float) -> DataFrame:
    """F1 and support of every category with a model or an entry, over all orders."""
    category = s.columns.category
    kind = s.models.schema[category].dataType.simpleString()

    def hits(keys, p, n):
        return {category: keys, "_absent": pa.array((p >= threshold) @ n)}

    absent = _over_absent(s, f"`{category}` {kind}, _absent bigint", hits)
    own = G.own_hits(s.present, [category], threshold)
    named = absent.select(category).union(own.select(category)).distinct()
    rows = join_same(join_same(named, absent, [category]), own, [category])
    return G.with_absent(rows, [category]).select(category, V.f1_ratio().alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def tuned_threshold(s: ScoredByCategory) -> float:
    """Threshold at which the orders get as many categories as they bought on average."""
    return V.best_threshold(threshold_curve_of(s)).first()["threshold"]
