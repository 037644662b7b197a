"""Column and group profiles: statistics, counts, crosstabs, histograms, null profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_fractional, parse_day
from .keys import join_same, measured
from .ordering import column_quantiles, quantiles


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without null keys: groups of null keys do not exist in these reports."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def group_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """min, max, mean, sample std and count of a value per group."""
    return (
        _present(df, by)
        .groupBy(*by)
        .agg(
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.count(value).alias("count"),
        )
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row per numeric column."""
    also = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return column_quantiles(df, columns, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, also)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per value, most frequent first; null is not counted."""
    return (
        _present(df, [column]).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), column)
    )


def group_center(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact median and mean per group."""
    return quantiles(_present(df, by), value, {"median": 0.5}, by, {"mean": F.avg})


def label_rate(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Mean of a 0/1 label per group."""
    return _present(df, by).groupBy(*by).agg(F.avg(label).alias("rate"), F.count(label).alias("count"))


def outcome_counts(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Rows with and without the label per group."""
    return (
        _present(df, by)
        .groupBy(*by)
        .agg(
            F.count_if(F.col(label) == 1).alias("positive"),
            F.count_if(F.coalesce(F.col(label) != 1, F.lit(True))).alias("negative"),
        )
    )


def daily_totals(df: DataFrame, day: str, value: str) -> DataFrame:
    return _present(df, [day]).groupBy(day).agg(F.sum(value).alias("total"))


def peak_days(totals: DataFrame, value: str = "total") -> DataFrame:
    """Rows that reach the largest total, ties kept."""
    top = totals.agg(F.max(value).alias("_top"))
    return totals.where(F.col(value) == top.scalar())


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, non-null count and type name per column, from one pass."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in columns])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"_n_{c}").alias("non_null"))
            for c in columns
        ]
    )
    return one.select("_rows", F.inline(cells)).select(
        "column", "type", "non_null", (F.col("_rows") - F.col("non_null")).alias("nulls"), F.col("_rows").alias("rows")
    )


def profile_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns only one side has and the null share on both sides."""
    a = null_profile(left).select(
        F.col("column").alias("a_column"), F.col("rows").alias("a_rows"), F.col("nulls").alias("a_nulls")
    )
    b = null_profile(right).select(
        F.col("column").alias("b_column"), F.col("rows").alias("b_rows"), F.col("nulls").alias("b_nulls")
    )
    return a.join(b, F.col("a_column") == F.col("b_column"), "full").select(
        F.coalesce("a_column", "b_column").alias("column"),
        F.when(F.col("b_column").isNull(), "left")
        .when(F.col("a_column").isNull(), "right")
        .otherwise("both")
        .alias("side"),
        F.try_divide("a_nulls", "a_rows").alias("left_null_share"),
        F.try_divide("b_nulls", "b_rows").alias("right_null_share"),
    )


def type_audit(df: DataFrame) -> DataFrame:
    """Float columns that hold only whole numbers and text columns that hold only dates, in one pass."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    sums = [F.count_if(F.col(c).isNotNull() & ~is_fractional(c)).alias(f"_ok_{c}") for c in floats]
    sums += [F.count(parse_day(c)).alias(f"_ok_{c}") for c in texts]
    sums += [F.count(c).alias(f"_n_{c}") for c in floats + texts]
    if not sums:
        raise ValueError("no float or text column to audit")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit("double" if c in floats else "string").alias("stored"),
                F.lit("bigint" if c in floats else "date").alias("would_fit"),
                F.col(f"_n_{c}").alias("values"),
                F.col(f"_ok_{c}").alias("fitting"),
            )
            for c in floats + texts
        ]
    )
    return (
        df.agg(*sums)
        .select(F.inline(cells))
        .withColumn("flagged", (F.col("values") > 0) & (F.col("values") == F.col("fitting")))
    )


def crosstab(df: DataFrame, rows: Sequence[str], column: str) -> DataFrame:
    """Counts in long form; fits a column of any cardinality."""
    return _present(df, [*rows, column]).groupBy(*rows, column).agg(F.count(F.lit(1)).alias("count"))


def crosstab_share(df: DataFrame, rows: Sequence[str], column: str, over: str) -> DataFrame:
    """Crosstab cells as share of their row (``over='index'``) or of their column (``over='columns'``).

    Only cells that occur are listed; a missing cell is 0. The denominators are summed from the counted
    cells, so no data row is shuffled twice.
    """
    cells = crosstab(df, rows, column)
    keys = list(rows) if over == "index" else [column]
    bases = cells.groupBy(*keys).agg(F.sum("count").alias("_base"))
    return join_same(cells, bases, keys).select(
        *rows, column, "count", (F.col("count") / F.col("_base")).alias("share")
    )


def crosstab_wide(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, over: str) -> DataFrame:
    """Shares as one column per listed value, 0 where the cell is empty."""
    cells = _present(df, [*rows, column]).groupBy(*rows).agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col(column) == v).alias(f"_n_{v}") for v in values],
    )
    if over == "index":
        shares = [(F.col(f"_n_{v}") / F.col("_all")).alias(f"share_{v}") for v in values]
    else:
        bases = cells.agg(*[F.sum(f"_n_{v}").alias(f"_b_{v}") for v in values])
        shares = [
            F.coalesce(F.try_divide(F.col(f"_n_{v}"), bases.select(f"_b_{v}").scalar()), F.lit(0.0)).alias(f"share_{v}")
            for v in values
        ]
    return cells.select(*rows, *shares)


def _bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin, last bin closed; decided by the edges, not by the rounded quotient."""
    step = (high - low) / bins
    guess = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    under = x < low + guess * step
    over = (x >= low + (guess + 1) * step) & (guess != bins - 1)
    return F.when(under, guess - 1).when(over, guess + 1).otherwise(guess).cast("int")


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal-width bins between a group's own minimum and maximum, empty bins included."""
    known = _present(df, [*by, value]).select(*by, F.col(value).cast("double").alias("_x"))
    ends = known.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(
        *by,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    if by:
        ends = measured(ends)
        ranged = join_same(known, ends, by, "inner")
    else:
        ranged = known.withColumns({c: ends.select(c).scalar() for c in ("_lo", "_hi")})
    counted = (
        ranged.withColumn("bin", _bin_of(F.col("_x"), F.col("_lo"), F.col("_hi"), bins))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    frame = ends.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    return join_same(frame, counted, [*by, "bin"]).select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * step).alias("lower"),
        F.coalesce("_count", F.lit(0)).cast("bigint").alias("count"),
    )


def most_frequent(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, smallest on ties; null does not compete."""
    counts = _present(df, [column]).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    best = F.min_by(column, F.struct(-F.col("_c"), F.col(column)))
    return counts.groupBy(*by).agg(best.alias(column))
