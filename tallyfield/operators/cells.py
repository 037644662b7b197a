"""Orders by categories without the grid: training, scoring and serving from the cells that are there.

A cell that no recent order touched has no lags; what tells it from another such cell is the calendar of its order
and the level of its category's rate. So all absent cells of one (calendar, level) are one weighted row, a score for
them is computed once, and every count over the whole grid is a count over the present cells plus weighted rows.
Levels are shares rounded to two significant digits, at most 811 however many categories there are.

Serving merges two lists for each customer: the scores of the customer's own cells, and the best absent categories
for the calendar, of which no more are looked at than the customer can be shown besides those already held.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_of, weekday_of
from ..session import cut_lineage
from .baskets import LineColumns, placed_basket
from .keys import join_same, measured
from .metrics import cumulated_curve, f1_ratio, jaccard_ratio, score_level

CALENDAR = ("month", "day_of_week", "days_since_last_order")
LEVEL = "category_rate"
Scorer = Callable[[DataFrame], DataFrame]


def rate_level(rate: Column) -> Column:
    """A share rounded to two significant digits, 0 below 1e-9."""
    scale = F.pow(F.lit(10.0), 1 - F.floor(F.log10(rate)))
    return F.when(rate >= 1e-9, F.floor(rate * scale + 0.5) / scale).otherwise(F.lit(0.0))


def placed_entries(
    orders: DataFrame, entries: DataFrame, marks: Sequence[str] = (), c: LineColumns = LineColumns(), calendar: Sequence[str] = CALENDAR
) -> DataFrame:
    """The entries of the orders with their calendar and marks, for those that need them several times.

    What takes orders and entries below takes these too and does not join them again; a condition on the orders is then
    one on the entries as well.
    """
    return join_same(entries, orders.select(c.customer, "seq", c.order, *calendar, *marks), [c.customer, "seq"], "inner")


def _are_placed(entries: DataFrame, calendar: Sequence[str] = CALENDAR) -> bool:
    return set(calendar) <= set(entries.columns)


def category_levels(categories: DataFrame, entries: DataFrame, trained: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """(category, rate level) of every category: the share of the ``trained`` orders whose target holds it."""
    n = max(trained.count(), 1)
    if not _are_placed(entries):
        entries = join_same(entries, trained.select(c.customer, "seq"), [c.customer, "seq"], "left_semi")
    bought = entries.groupBy(c.category)
    share = bought.agg((F.sum("target") / n).alias("_share"))
    rates = join_same(categories.select(c.category), share, [c.category])
    return rates.select(c.category, rate_level(F.coalesce("_share", F.lit(0.0))).alias(LEVEL))


def present_cells(
    orders: DataFrame, entries: DataFrame, rates: DataFrame, c: LineColumns = LineColumns(), calendar: Sequence[str] = CALENDAR
) -> DataFrame:
    """The entries of the orders with the columns of the order and the level of the category."""
    held = entries if _are_placed(entries, calendar) else join_same(entries, orders, [c.customer, "seq"], "inner")
    return join_same(held, rates, [c.category], "inner")


def _with_levels(groups: DataFrame, rates: DataFrame) -> DataFrame:
    """Every level, with the number of its categories, on every group."""
    levels = rates.groupBy(LEVEL).agg(F.count(F.lit(1)).alias("n_categories"))
    # at most 811 levels
    every = levels.agg(F.collect_list(F.struct(LEVEL, "n_categories"))).scalar()
    return groups.withColumn("_levels", every).select(*groups.columns, F.inline("_levels"))


def absent_cells(orders: DataFrame, present: DataFrame, rates: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """(by, level, weight): how many cells without an entry the orders of each group have at each level.

    A row of ``present`` is one cell, or as many as its ``weight`` says.
    """
    groups = orders.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orders"))
    seen = present.groupBy(*by, LEVEL).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n_present"))
    out = join_same(_with_levels(groups, rates), seen, [*by, LEVEL])
    left = F.col("n_orders") * F.col("n_categories") - F.coalesce("n_present", F.lit(0))
    return out.select(*by, LEVEL, left.alias("weight")).where("weight > 0")


def training_cells(
    orders: DataFrame, entries: DataFrame, rates: DataFrame, marks: Sequence[str] = (), c: LineColumns = LineColumns(), calendar: Sequence[str] = CALENDAR
) -> DataFrame:
    """Distinct (marks, calendar, lags, level, target) with the number of grid cells that have them as ``weight``."""
    by = [*marks, *calendar]
    cells = ["lag1", "lag2", "target", LEVEL]
    zero = {"lag1": F.lit(0).cast("bigint"), "lag2": F.lit(0).cast("bigint"), "target": F.lit(0)}
    # written, since the absent cells are counted from it too
    present = present_cells(orders, entries, rates, c, calendar)
    held = cut_lineage(present.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("weight")), "held")
    absent = absent_cells(orders, held, rates, by, "weight").withColumns(zero)
    return held.unionByName(absent).groupBy(*by, *cells).agg(F.sum("weight").alias("weight"))


@dataclass(frozen=True)
class ScoredCells:
    """Scores of a whole grid; each table is scored and written when it is first asked for.

    ``orders``: one row each; ``present``: the cells with an entry, with the ``probability`` and the one they would have
    ``if_absent``; ``groups``: (calendar, level, n_orders, n_categories, probability) of absent cells; ``rates``:
    (category, level) of every category; ``counted``: the distinct cells of the grid, present or absent, with their
    ``target``, ``weight`` and ``probability``, if the grid has them.
    """

    grid: Grid
    score: Scorer

    @property
    def orders(self) -> DataFrame:
        return self.grid.orders

    @property
    def rates(self) -> DataFrame:
        return self.grid.rates

    @property
    def calendar(self) -> Sequence[str]:
        return self.grid.calendar

    @property
    def columns(self) -> LineColumns:
        return self.grid.columns

    @cached_property
    def groups(self) -> DataFrame:
        by = [*self.calendar, LEVEL]
        zero = {"lag1": F.lit(0).cast("bigint"), "lag2": F.lit(0).cast("bigint")}
        counted = self.grid.groups.groupBy(*by, "n_categories").agg(F.sum("n_orders").alias("n_orders"))
        groups = self.score(counted.withColumns(zero)).select(*by, "n_orders", "n_categories", "probability")
        return cut_lineage(groups, "absent")

    @cached_property
    def present(self) -> DataFrame:
        by = [*self.calendar, LEVEL]
        alone = self.groups.select(*by, F.col("probability").alias("if_absent"))
        return cut_lineage(join_same(self.score(self.grid.present), alone, by, "inner"), "present")

    @cached_property
    def counted(self) -> DataFrame | None:
        return None if self.grid.counted is None else self.score(self.grid.counted)


@dataclass(frozen=True)
class Grid:
    """Orders by categories, ready to be scored by several models; ``marks`` are columns to choose orders by.

    ``counted`` are its training cells, if they are known: the distinct cells with their weight.
    """

    orders: DataFrame
    present: DataFrame
    groups: DataFrame
    rates: DataFrame
    calendar: Sequence[str]
    columns: LineColumns
    counted: DataFrame | None = None

    def where(self, condition: str) -> Grid:
        """The orders whose marks fulfil the condition."""
        return Grid(*(t.where(condition) for t in (self.orders, self.present, self.groups)), self.rates, self.calendar, self.columns)

    def scored(self, score: Scorer) -> ScoredCells:
        """``score`` adds ``probability`` to rows of calendar, lags and level."""
        return ScoredCells(self, score)


def open_grid(
    orders: DataFrame,
    entries: DataFrame,
    rates: DataFrame,
    marks: Sequence[str] = (),
    c: LineColumns = LineColumns(),
    calendar: Sequence[str] = CALENDAR,
    counted: DataFrame | None = None,
) -> Grid:
    """Present cells and groups of absent ones, written once, or not if the cells are ``counted`` already."""
    each = orders.groupBy(*marks, *calendar).agg(F.count(F.lit(1)).alias("n_orders"))
    groups, present = _with_levels(each, rates), present_cells(orders, entries, rates, c, calendar)
    if counted is None:
        groups, present = cut_lineage(groups, "groups"), cut_lineage(present, "cells")
    return Grid(orders, present, groups, rates, calendar, c, counted)


def score_cells(
    orders: DataFrame, entries: DataFrame, rates: DataFrame, score: Scorer, c: LineColumns = LineColumns(), calendar: Sequence[str] = CALENDAR
) -> ScoredCells:
    """Score every cell of the orders."""
    return open_grid(orders, entries, rates, (), c, calendar).scored(score)


def threshold_curve_of(s: ScoredCells) -> DataFrame:
    """The threshold curve over all cells of the grid; equal cells are scored once if they are counted."""
    orders = s.orders.agg(F.count(F.lit(1)).alias("orders"))
    if s.counted is not None:
        counts = s.counted.groupBy(score_level("probability").alias("_level")).agg(F.sum("weight").alias("_c"))
        bought = F.coalesce(F.sum(F.when(F.col("target") > 0, F.col("weight"))), F.lit(0)).alias("bought")
        return cumulated_curve(counts, orders, s.grid.counted.agg(bought))
    seen = s.present.groupBy(*s.calendar, LEVEL).agg(F.count(F.lit(1)).alias("n_present"))
    weight = F.col("n_orders") * F.col("n_categories") - F.coalesce("n_present", F.lit(0))
    absent = join_same(s.groups, seen, [*s.calendar, LEVEL]).select("probability", weight.alias("weight"))
    cells = s.present.select("probability", F.lit(1).cast("bigint").alias("weight")).union(absent)
    counts = cells.groupBy(score_level("probability").alias("_level")).agg(F.sum("weight").alias("_c"))
    base = s.present.agg(F.count_if(F.col("target") > 0).alias("bought"))
    return cumulated_curve(counts, orders, base)


def own_hits(present: DataFrame, keys: Sequence[str], threshold: float | Column) -> DataFrame:
    """tp, fp and fn among the present cells, and how many would be hit in their place if they were absent."""
    hit, true = F.col("probability") >= threshold, F.col("target") > 0
    return present.groupBy(*keys).agg(
        F.count_if(true & hit).alias("tp"),
        F.count_if(~true & hit).alias("fp"),
        F.count_if(true & ~hit).alias("fn"),
        F.count_if(F.col("if_absent") >= threshold).alias("_instead"),
    )


def with_absent(rows: DataFrame, out: Sequence[str]) -> DataFrame:
    """False hits among absent cells: all that would be hit if none were present, less those that are present."""
    n = {k: F.coalesce(k, F.lit(0)) for k in ("tp", "fp", "fn", "_instead", "_absent")}
    return rows.select(*out, n["tp"].alias("tp"), (n["fp"] + n["_absent"] - n["_instead"]).alias("fp"), n["fn"].alias("fn"))


def unit_scores(s: ScoredCells, threshold: float | Column) -> DataFrame:
    """tp, fp, fn, F1 and Jaccard of every order over all categories."""
    c = s.columns
    absent = s.groups.where(F.col("probability") >= threshold).groupBy(*s.calendar).agg(F.sum("n_categories").alias("_absent"))
    rows = join_same(s.orders.select(c.customer, c.order, *s.calendar), measured(absent), s.calendar)
    rows = join_same(rows, own_hits(s.present, [c.customer, c.order], threshold), [c.customer, c.order])
    return with_absent(rows, [c.customer, c.order]).withColumns({"f1": f1_ratio(), "jaccard": jaccard_ratio()})


def category_f1(s: ScoredCells, threshold: float | Column) -> DataFrame:
    """F1 and support of every category over all orders."""
    category = s.columns.category
    absent = s.groups.where(F.col("probability") >= threshold).groupBy(LEVEL).agg(F.sum("n_orders").alias("_absent"))
    rows = join_same(join_same(s.rates, measured(absent), [LEVEL]), own_hits(s.present, [category], threshold), [category])
    return with_absent(rows, [category]).select(category, f1_ratio().alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


# --- serving ----------------------------------------------------------------------------------------


def serving_heads(sequence: DataFrame, today: dt.date, c: LineColumns = LineColumns()) -> DataFrame:
    """One row per customer: the last day and the calendar of ``today``."""
    day = F.lit(today).cast("date")
    return sequence.where(F.col("seq") == F.col("n")).select(
        c.customer,
        F.col(c.day).alias("last_day"),
        month_of(day).alias("month"),
        weekday_of(day).alias("day_of_week"),
        F.greatest(F.lit(0), F.datediff(day, c.day)).alias("days_since_last_order"),
    )


def serving_cells(basket: DataFrame, sequence: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """(customer, category, lag1, lag2) of the last two baskets."""
    late = F.col("seq") >= F.col("n") - 1
    placed = placed_basket(basket, sequence.where(late), c).where(late)
    amount = F.col(c.amount)
    return placed.groupBy(c.customer, c.category).agg(
        F.sum(F.when(F.col("seq") == F.col("n"), amount).otherwise(0)).alias("lag1"),
        F.sum(F.when(F.col("seq") < F.col("n"), amount).otherwise(0)).alias("lag2"),
    )


def _best_absent(served: DataFrame, rates: DataFrame, score: Scorer, threshold: float | Column, category: str, calendar: Sequence[str]) -> DataFrame:
    """(calendar, list): the best categories for each calendar if absent, as many as any of its customers can need."""
    needed = served.groupBy(*calendar).agg(F.max("_need").alias("_most"))
    zero = {"lag1": F.lit(0).cast("bigint"), "lag2": F.lit(0).cast("bigint")}
    scored = score(_with_levels(needed, rates).withColumns(zero)).where(F.col("probability") >= threshold)
    scored = cut_lineage(scored.select(*calendar, "_most", LEVEL, "n_categories", "probability"), "levels")
    steps = scored.groupBy(*calendar, "probability").agg(F.sum("n_categories").alias("_held"))
    # at most one step per level
    above = Window.partitionBy(*calendar).orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_ahead", F.coalesce(F.sum("_held").over(above), F.lit(0)))
    wanted = join_same(scored, steps.select(*calendar, "probability", "_ahead"), [*calendar, "probability"], "inner").where("_ahead < _most")
    # of a level only its first categories can be needed; the limit is pushed below the shuffle
    most = needed.agg(F.max("_most")).first()[0] or 0
    first = F.row_number().over(Window.partitionBy(LEVEL).orderBy(category))
    firsts = rates.withColumn("_first", first).where(F.col("_first") <= most)
    listed = join_same(wanted, firsts, [LEVEL], "inner").where("_first <= _most")
    place = F.row_number().over(Window.partitionBy(*calendar).orderBy(F.desc("probability"), category))
    listed = listed.withColumn("_place", place).where("_place <= _most")
    cell = F.struct("_place", category, "probability")
    return measured(listed.groupBy(*calendar).agg(F.sort_array(F.collect_list(cell)).alias("_list")))


def merged_suggestions(
    heads: DataFrame,
    own: DataFrame,
    rates: DataFrame,
    score: Scorer,
    threshold: float | Column,
    show: DataFrame,
    c: LineColumns = LineColumns(),
    calendar: Sequence[str] = CALENDAR,
) -> DataFrame:
    """Categories at or above the threshold, best first, as many per customer as ``show.n_to_show`` says.

    The same as ranking every category for every customer; rows are the customer's own cells and as many of the best
    absent categories as fill what is shown if all the own ones stand before them.
    """
    own = cut_lineage(join_same(own, rates, [c.category], "inner"), "own")
    held = own.groupBy(c.customer).agg(F.count(F.lit(1)).alias("_held"))
    served = join_same(join_same(heads, show.select(c.customer, "n_to_show"), [c.customer], "inner"), held, [c.customer])
    served = cut_lineage(served.withColumn("_need", F.col("n_to_show") + F.coalesce("_held", F.lit(0))), "served")
    best = _best_absent(served, rates, score, threshold, c.category, calendar)
    absent = join_same(served, best, calendar, "inner").where("_need > 0")
    absent = absent.select(c.customer, "n_to_show", F.inline(F.slice("_list", F.lit(1), F.col("_need").cast("int"))))
    absent = join_same(absent, own.select(c.customer, c.category), [c.customer, c.category], "left_anti")
    kept = score(join_same(own, served, [c.customer], "inner")).where(F.col("probability") >= threshold)
    columns = [c.customer, c.category, "probability", "n_to_show"]
    both = kept.select(*columns).unionByName(absent.select(*columns))
    place = F.row_number().over(Window.partitionBy(c.customer).orderBy(F.desc("probability"), F.col(c.category)))
    return both.withColumn("rank", place).where(F.col("rank") <= F.col("n_to_show"))


def predicted_counts(
    heads: DataFrame, own: DataFrame, rates: DataFrame, score: Scorer, threshold: float | Column, c: LineColumns = LineColumns(), calendar: Sequence[str] = CALENDAR
) -> DataFrame:
    """(customer, n_predicted): how many of all categories reach the threshold."""
    cells = own.withColumns({"target": F.lit(0), "seq": F.lit(0)})
    orders = heads.withColumns({"seq": F.lit(0), c.order: F.col(c.customer)})
    scores = unit_scores(score_cells(orders, cells, rates, score, c, calendar), threshold)
    return scores.select(c.customer, F.col("fp").alias("n_predicted"))
