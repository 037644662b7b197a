"""Data-quality checks on a sales-like table: keys, periods, prices, quantities.

Group checks aggregate first and only then fetch rows: ``count`` and ``min < max`` combine on the map
side in fixed space, so a key holding a third of the table costs one partial row per task. The violating
keys, not the table, are what the second step joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_space, has_stray_quote, is_fractional, percent
from .joins import attribute_mismatch, orphans, rows_with_keys
from .ordering import quantiles


def _without_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def period(df: DataFrame, day: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, first day, last day and the days between."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("violations"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.datediff(F.max(day), F.min(day)).alias("days"),
    )


def finding(df: DataFrame, where: Column, day: str) -> DataFrame:
    """One pass: rows that match, their share of the table in percent and their period."""
    hit = F.coalesce(where, F.lit(False))
    return df.agg(
        F.count_if(hit).alias("violations"),
        percent(F.count_if(hit), F.count(F.lit(1))).alias("pct"),
        F.min(F.when(hit, F.col(day))).alias("first_day"),
        F.max(F.when(hit, F.col(day))).alias("last_day"),
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key tuples that occur more than once; null is a key value like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of a repeated key."""
    return rows_with_keys(df, repeated_keys(df, keys), keys)


def later_copies(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows after the first of their key; ``order`` must identify a row."""
    # the pass over the whole table only counts; the first row is looked for among rows of repeated keys
    rows = duplicates(df, keys)
    firsts = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    side = firsts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_first")
    return rows.join(side, on, "inner").where(F.struct(*order) > F.col("_first")).select(*df.columns)


def conflicting_keys(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, and how many; null values and null keys do not count."""
    return (
        _without_null(df, keys)
        .groupBy(*keys)
        .agg(F.count_distinct(value).alias("n_values"))
        .where(F.col("n_values") > 1)
    )


def has_conflict(value: str) -> Column:
    """Aggregate form of "more than one distinct value"."""
    return F.min(value) < F.max(value)


def conflicting_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of the keys that carry more than one distinct value."""
    bad = _without_null(df, keys).groupBy(*keys).agg(has_conflict(value).alias("_bad")).where("_bad")
    return rows_with_keys(df, bad, keys)


def values_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key, for describing how unique a value is."""
    return _without_null(df, keys).groupBy(*keys).agg(F.count_distinct(value).alias("n_values"))


def tukey_fences(df: DataFrame, value: str, width: float = 1.5) -> DataFrame:
    """Quartiles, their range and the fences ``width`` ranges outside them."""
    q = quantiles(df, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        "q1",
        "q2",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - width * iqr).alias("lower"),
        (F.col("q3") + width * iqr).alias("upper"),
    )


def outliers(df: DataFrame, value: str, fences: DataFrame | None = None, cutoff: float | None = None) -> DataFrame:
    """Rows above the fixed cut-off if one is given, else outside the fences."""
    if cutoff is not None:
        return df.where(F.col(value) > cutoff)
    fences = tukey_fences(df, value) if fences is None else fences
    return df.where(
        (F.col(value) < fences.select("lower").scalar()) | (F.col(value) > fences.select("upper").scalar())
    )


def nulls_by_period(df: DataFrame, column: str, threshold: float, day: str, unit: str = "month") -> DataFrame:
    """Periods in which the null share of a column exceeds the threshold."""
    return (
        df.groupBy(F.trunc(day, unit).alias("period"))
        .agg(F.count_if(F.col(column).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows"))
        .withColumn("share", F.col("nulls") / F.col("rows"))
        .where(F.col("share") > threshold)
    )


def flag_returns(df: DataFrame, quantity: str) -> DataFrame:
    """Mark rows that take goods back, so that sales can be totalled without them."""
    kind = F.when(F.col(quantity) < 0, "return").when(F.col(quantity) == 0, "empty").otherwise("sale")
    return df.withColumn("kind", F.when(F.col(quantity).isNull(), F.lit(None)).otherwise(kind))


def text_format(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose key text holds a space or a stray quote, counted per column in one pass."""
    sums = []
    for c in columns:
        sums.append(F.count_if(has_space(c)).alias(f"_s_{c}"))
        sums.append(F.count_if(has_stray_quote(F.col(c).cast("string"))).alias(f"_q_{c}"))
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_s_{c}").alias("with_space"), F.col(f"_q_{c}").alias("with_quote"))
            for c in columns
        ]
    )
    return df.agg(*sums).select(F.inline(cells))


def repair_price(
    df: DataFrame, keys: Sequence[str], day: str, price: str, days: int = 60, out: str = "repaired"
) -> DataFrame:
    """Fill a missing price with the mean price of the same keys over the following days.

    Only keys that miss a price are looked at. Prices are summed per key and day first; the range window
    then runs over calendar days, of which a key has a few thousand at most, however many rows it holds.
    """
    gaps = df.where(F.col(price).isNull()).select(*keys).distinct()
    daily = rows_with_keys(df, gaps, keys).groupBy(*keys, day).agg(
        F.sum(price).alias("_s"), F.count(price).alias("_c"), (F.count(F.lit(1)) > F.count(price)).alias("_gap")
    )
    ahead = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(1, days)
    means = daily.withColumn("_mean", F.sum("_s").over(ahead) / F.nullif(F.sum("_c").over(ahead), F.lit(0)))
    # only days with a gap are looked up, and rows with a price keep it
    means = means.where("_gap").select(*[F.col(c).alias(f"_r_{c}") for c in [*keys, day]], "_mean")
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in [*keys, day]]
    return df.join(means, on, "left").select(*df.columns, F.coalesce(F.col(price).cast("double"), "_mean").alias(out))


@dataclass(frozen=True)
class SalesColumns:
    """Column names of a sales table."""

    article: str = "article_id"
    site: str = "site_id"
    zone: str = "zone_id"
    day: str = "day"
    quantity: str = "quantity"
    price: str = "price"
    cost: str = "cost_price"


def orphan_sites(sales: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    return orphans(sales, sites, key, key)


def zone_mismatches(sales: DataFrame, sites: DataFrame) -> DataFrame:
    return attribute_mismatch(sales, sites, "site_id", "site_id", "zone_id", "site_zone_id")


def fractional_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_fractional(column))


def integer_share(df: DataFrame, column: str) -> DataFrame:
    """How many values are whole and how many are not."""
    return df.groupBy((~is_fractional(column)).alias("is_integer")).agg(F.count(F.lit(1)).alias("count"))
