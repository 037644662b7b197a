"""Category enrichment, baskets in long form, lag features and serving rows for many customers.

The order sequence is numbered once (``sequence_orders``). Lags and targets are then plain equality on
(customer, position): each basket entry is sent to the positions that look at it and one aggregation
collects them. No customer is ever sorted in one task and no order x category grid is built.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import month_of, weekday_of, whole
from .joins import lookup, map_values, new_keys, rows_with_keys, upsert
from .keys import join_same
from .ordering import number_rows

# Fixed value: category id given to products that left the catalogue.
DISCONTINUED_CATEGORY = 300112985


@dataclass(frozen=True)
class LineColumns:
    """Column names of order lines and of the product dimension."""

    customer: str = "customer_id"
    order: str = "order_id"
    day: str = "day"
    product: str = "product_id"
    name: str = "name"
    category: str = "category_id"
    amount: str = "amount"
    status: str = "status"


def apply_categories(
    lines: DataFrame,
    dim: DataFrame,
    c: LineColumns = LineColumns(),
    delete_not_found: bool = False,
    default: int = DISCONTINUED_CATEGORY,
) -> DataFrame:
    """Give lines the category of their product.

    Failed products are always dropped, discontinued ones get the default category or are dropped too;
    products the dimension does not know keep a null category. One join serves all three rules.
    """
    packed = dim.select(c.product, F.struct(c.status, c.category).alias("_dim"))
    joined = map_values(lines, packed, c.product, c.product, "_dim", "_dim")
    status = F.col(f"_dim.{c.status}")
    dropped = ["error", "not_found"] if delete_not_found else ["error"]
    kept = joined.where(status.isNull() | ~status.isin(dropped))
    category = F.when(status == "not_found", F.lit(default)).otherwise(F.col(f"_dim.{c.category}"))
    return kept.select(*lines.columns, category.cast("bigint").alias(c.category))


def status_report(lines: DataFrame, dim: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """Products that are not ok, with a name seen in the lines."""
    failed = dim.where(F.col(c.status) != "ok").select(c.status, c.product)
    names = rows_with_keys(lines, failed, [c.product]).groupBy(c.product).agg(F.min(c.name).alias(c.name))
    return lookup(failed, names, c.product, c.product, {c.name: c.name})


def refresh_categories(lines: DataFrame, dim: DataFrame, fetched: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """Dimension plus the products first seen in these lines; a product nobody could supply is an error."""
    fresh = new_keys(lines, dim, c.product, c.product)
    found = join_same(fresh, fetched, [c.product], "left")
    found = found.withColumn(c.status, F.coalesce(c.status, F.lit("error")))
    return upsert(dim, found.select(*dim.columns), [c.product])


def refresh_counts(lines: DataFrame, dim: DataFrame, fetched: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """How many new products came back ok and how many failed."""
    fresh = new_keys(lines, dim, c.product, c.product)
    found = join_same(fresh, fetched.select(c.product, c.status), [c.product], "left")
    ok = F.coalesce(F.col(c.status) == "ok", F.lit(False))
    return found.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


def basket_long(lines: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """Total amount per order and category; lines without a category do not count."""
    return (
        lines.where(F.col(c.category).isNotNull())
        .groupBy(c.customer, c.order, c.category)
        .agg(whole(F.sum(c.amount)).alias(c.amount))
    )


def basket_wide(basket: DataFrame, categories: list, c: LineColumns = LineColumns()) -> DataFrame:
    """One column per listed category, 0 where nothing was bought."""
    wide = basket.groupBy(c.customer, c.order).pivot(c.category, categories).sum(c.amount)
    return wide.select(
        c.customer, c.order, *[whole(F.col(f"`{k}`")).alias(f"cat_{k}") for k in categories]
    )


def category_table(basket: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """Every category that occurs, however many there are."""
    return basket.select(c.category).distinct()


def _every(categories: DataFrame, c: LineColumns) -> Column:
    """All categories in order as one array, gathered by a subquery when the plan runs."""
    return categories.agg(F.sort_array(F.collect_list(c.category))).scalar()


def order_days(lines: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """One day per order: the earliest known one."""
    return lines.groupBy(c.customer, c.order).agg(F.min(c.day).alias(c.day))


def sequence_orders(orders: DataFrame, c: LineColumns = LineColumns(), by_order_id: bool = False) -> DataFrame:
    """Position of each order in its customer's history and the length of that history.

    ``by_order_id`` reproduces histories ordered by the order key alone; the default is day, then key.
    """
    order = [c.order] if by_order_id else [c.day, c.order]
    return number_rows(orders.select(c.customer, c.order, c.day), [c.customer], order)


def order_features(sequence: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """month, Monday-based weekday and days since the previous order (0 for the first)."""
    own = [c.order, c.day, "n"]
    kinds = dict(sequence.dtypes)
    here = F.struct(F.col("seq"), *[F.col(k) for k in own], F.lit(None).cast(kinds[c.day]).alias("_last"))
    there = F.struct(
        (F.col("seq") + 1).alias("seq"),
        *[F.lit(None).cast(kinds[k]).alias(k) for k in own],
        F.col(c.day).alias("_last"),
    )
    sent = sequence.select(c.customer, F.inline(F.array(here, there)))
    met = sent.groupBy(c.customer, "seq").agg(*[F.max(k).alias(k) for k in [*own, "_last"]])
    day = F.col(c.day)
    return met.where(F.col("n").isNotNull()).select(
        c.customer,
        c.order,
        c.day,
        "seq",
        "n",
        month_of(day).alias("month"),
        weekday_of(day).alias("day_of_week"),
        F.coalesce(F.datediff(day, "_last"), F.lit(0)).alias("days_since_last_order"),
    )


def trained_positions(target_offset: int = 1) -> Column:
    """Positions with two earlier orders and, for a next-order target, one later order."""
    return F.col("seq").between(F.lit(3), F.col("n") - target_offset)


def placed_basket(basket: DataFrame, sequence: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """The basket with the position of its order and the length of the history; one that has them is left as it is."""
    if {"seq", "n"} <= set(basket.columns):
        return basket
    return join_same(basket, sequence.select(c.customer, c.order, "seq", "n"), [c.customer, c.order], "inner")


def lag_entries(
    basket: DataFrame, sequence: DataFrame, c: LineColumns = LineColumns(), target_offset: int = 1, trim: bool = True
) -> DataFrame:
    """Amounts one and two orders ago and whether the target order bought the category.

    Sparse: a (customer, position, category) without a row is 0 / 0 / not bought. ``target_offset=1``
    looks at the order after the position, 0 at the position itself (lags and target then line up as
    they do when serving). ``trim=False`` keeps warm-up and tail positions.
    """
    placed = placed_basket(basket, sequence, c).where(F.col(c.amount) != 0)
    zero, amount = F.lit(0).cast("bigint"), F.col(c.amount).cast("bigint")

    def to(place: Column, lag1: Column, lag2: Column, bought: Column) -> Column:
        return F.struct(place.alias("seq"), lag1.alias("lag1"), lag2.alias("lag2"), bought.alias("target"))

    bought = F.when(F.col(c.amount) > 0, 1).otherwise(0)
    sent = placed.select(
        c.customer,
        c.category,
        "n",
        F.inline(
            F.array(
                to(F.col("seq") + 1, amount, zero, F.lit(0)),
                to(F.col("seq") + 2, zero, amount, F.lit(0)),
                to(F.col("seq") - target_offset, zero, zero, bought),
            )
        ),
    )
    wanted = trained_positions(target_offset) if trim else F.col("seq").between(F.lit(1), F.col("n"))
    return (
        sent.where(wanted)
        .groupBy(c.customer, "seq", c.category)
        .agg(F.sum("lag1").alias("lag1"), F.sum("lag2").alias("lag2"), F.max("target").alias("target"))
    )


def training_long(
    features: DataFrame, entries: DataFrame, categories: DataFrame, c: LineColumns = LineColumns(), target_offset: int = 1
) -> DataFrame:
    """One row per trained order and category, zeros filled in: the rows a pooled model learns from."""
    dense = features.where(trained_positions(target_offset)).withColumn("_all", _every(categories, c))
    dense = dense.select(*features.columns, F.explode("_all").alias(c.category))
    out = join_same(dense, entries, [c.customer, "seq", c.category], "left")
    filled = {k: F.coalesce(k, F.lit(0)) for k in ("lag1", "lag2", "target")}
    return out.withColumns(filled)


def training_wide(
    features: DataFrame, entries: DataFrame, categories: DataFrame, c: LineColumns = LineColumns(), target_offset: int = 1
) -> DataFrame:
    """One row per trained order with lag1, lag2 and target arrays in category order."""
    cell = F.struct(F.col(c.category), F.struct("lag1", "lag2", "target"))
    # at most one entry per category, so the list is as long as the category list at most
    maps = entries.groupBy(c.customer, "seq").agg(F.map_from_entries(F.collect_list(cell)).alias("_cells"))
    rows = join_same(features.where(trained_positions(target_offset)), maps, [c.customer, "seq"], "left")

    def block(part: str) -> Column:
        return F.transform("_all", lambda k: F.coalesce(F.col("_cells")[k][part], F.lit(0))).alias(part)

    return rows.withColumn("_all", _every(categories, c)).select(*[f for f in features.columns], block("lag1"), block("lag2"), block("target"))


def serving_rows(
    basket: DataFrame, sequence: DataFrame, categories: DataFrame, today: dt.date, c: LineColumns = LineColumns()
) -> DataFrame:
    """Features of each customer's next order: the last two baskets and the calendar of ``today``."""
    late = F.col("seq") >= F.col("n") - 1
    last = sequence.where(F.col("seq") == F.col("n"))
    day = F.lit(today).cast("date")
    heads = last.select(
        c.customer,
        F.col(c.day).alias("last_day"),
        month_of(day).alias("month"),
        weekday_of(day).alias("day_of_week"),
        F.greatest(F.lit(0), F.datediff(day, c.day)).alias("days_since_last_order"),
    )
    placed = placed_basket(basket, sequence.where(late), c).where(late)
    cells = placed.groupBy(c.customer, c.category).agg(
        F.sum(F.when(F.col("seq") == F.col("n"), F.col(c.amount)).otherwise(0)).alias("lag1"),
        F.sum(F.when(F.col("seq") < F.col("n"), F.col(c.amount)).otherwise(0)).alias("lag2"),
    )
    grid = heads.withColumn("_all", _every(categories, c)).select(*heads.columns, F.explode("_all").alias(c.category))
    out = join_same(grid, cells, [c.customer, c.category], "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("lag1", "lag2")})


def basket_width(basket: DataFrame, sequence: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    """Mean number of categories per order and the number of suggestions to show, rounded half to even."""
    bought = (
        basket.where(F.col(c.amount) > 0).groupBy(c.customer).agg(F.count(F.lit(1)).alias("_cells"))
    )
    orders = sequence.groupBy(c.customer).agg(F.count(F.lit(1)).alias("_orders"))
    width = F.coalesce(F.col("_cells"), F.lit(0)) / F.col("_orders")
    return join_same(orders, bought, [c.customer], "left").select(
        c.customer, width.alias("mean_width"), F.bround(width, 0).cast("int").alias("n_to_show")
    )


def distinct_days(orders: DataFrame, c: LineColumns = LineColumns()) -> DataFrame:
    return orders.groupBy(c.customer).agg(F.count_distinct(c.day).alias("n_days"))


def top_categories(entries: DataFrame, categories: DataFrame, c: LineColumns = LineColumns(), share: float = 0.10) -> DataFrame:
    """The most bought tenth of the categories, at least one."""
    k = max(1, round(categories.count() * share))
    totals = entries.groupBy(c.category).agg(F.sum("target").cast("bigint").alias("positives"))
    return totals.orderBy(F.desc("positives"), c.category).limit(k)


def category_examples(products: DataFrame, c: LineColumns = LineColumns(), keep: int = 3) -> DataFrame:
    """First products of each category by id: example_1.. and id_product_1..

    The rank filter is pushed below the shuffle, so each task sends ``keep`` products per category.
    """
    place = F.row_number().over(Window.partitionBy(c.category).orderBy(c.product))
    first = (
        products.where(F.col(c.category).isNotNull())
        .select(c.category, c.product, c.name)
        .withColumn("_place", place)
        .where(F.col("_place") <= keep)
    )
    at = [F.when(F.col("_place") == i, F.struct(c.name, c.product)) for i in range(1, keep + 1)]
    packed = first.groupBy(c.category).agg(*[F.max(a).alias(f"_e{i}") for i, a in enumerate(at, 1)])
    return packed.select(
        c.category,
        *[F.col(f"_e{i}.{c.name}").alias(f"example_{i}") for i in range(1, keep + 1)],
        *[F.col(f"_e{i}.{c.product}").alias(f"id_product_{i}") for i in range(1, keep + 1)],
    )


def rank_suggestions(
    scored: DataFrame, threshold: float | Column, show: DataFrame, c: LineColumns = LineColumns(), probability: str = "probability"
) -> DataFrame:
    """Categories at or above the threshold, best first, as many per customer as ``show.n_to_show`` says."""
    kept = scored.where(F.col(probability) >= threshold)
    place = F.row_number().over(
        Window.partitionBy(c.customer).orderBy(F.desc(probability), F.col(c.category))
    )
    ranked = kept.withColumn("rank", place)
    return join_same(ranked, show.select(c.customer, "n_to_show"), [c.customer], "inner").where(
        F.col("rank") <= F.col("n_to_show")
    )
