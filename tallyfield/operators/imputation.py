"""Group medians for missing values, medians learned elsewhere, group sizes, scaling and encoding tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import join_same, measured
from .ordering import number_rows, quantiles
from .profiles import most_frequent


def fill_group_median(df: DataFrame, by: Sequence[str], value: str, medians_of: DataFrame | None = None) -> DataFrame:
    """Fill a missing value with the median of its group, from another table if one is given.

    A group without any value stays null, and so do rows with a null key.
    """
    source = df if medians_of is None else medians_of
    for k in by:
        source = source.where(F.col(k).isNotNull())
    medians = quantiles(source, value, {"_median": 0.5}, by)
    joined = join_same(df, measured(medians), by)
    return joined.select(
        *[F.coalesce(F.col(c).cast("double"), "_median").alias(c) if c == value else F.col(c) for c in df.columns]
    )


def group_size(df: DataFrame, key: str, out: str = "group_size") -> DataFrame:
    """How many rows share the key; null for a null key. Only keys of several rows are looked up, so a key that hardly
    ever repeats makes a small side."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) > 1)
    joined = join_same(df, measured(sizes), [key])
    return joined.withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce(out, F.lit(1).cast("bigint"))))


def scaling_table(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population std per column, one row; a constant column divides by 1."""
    std = [F.stddev_pop(c) for c in columns]
    return train.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.when(s == 0, 1.0).otherwise(s).alias(f"{c}_std") for c, s in zip(columns, std)],
    )


def scale(df: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std with the values learned on the training table."""
    done = {
        c: (F.col(c) - table.select(f"{c}_mean").scalar()) / table.select(f"{c}_std").scalar() for c in columns
    }
    return df.withColumns(done)


def fill_most_frequent(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing categories with the training table's most frequent value, smallest on ties."""
    return df.withColumns({c: F.coalesce(F.col(c), most_frequent(train, c).scalar()) for c in columns})


def one_hot_long(df: DataFrame, train: DataFrame, key: str, column: str) -> DataFrame:
    """(key, category, index) of the 1 cells; a category the training table lacks raises an error.

    Categories are the sorted distinct training values, numbered from 0.
    """
    known = train.select(F.col(column).alias("category")).where(F.col("category").isNotNull()).distinct()
    indexed = number_rows(known, [], ["category"], "place", None).select(
        "category", (F.col("place") - 1).alias("category_index")
    )
    cells = df.select(key, F.col(column).alias("category"))
    found = join_same(cells, measured(indexed), ["category"])
    unseen = F.raise_error(F.concat(F.lit("unseen category "), F.coalesce("category", F.lit("null"))))
    return found.withColumn(
        "category_index", F.when(F.col("category_index").isNull(), unseen).otherwise(F.col("category_index"))
    )


def soft_vote(df: DataFrame, probabilities: Sequence[str]) -> DataFrame:
    """Mean probability; a tie between the classes goes to 0."""
    mean = sum((F.col(p) for p in probabilities), F.lit(0.0)) / len(probabilities)
    return df.withColumn("probability", mean).withColumn(
        "prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0)
    )


def hard_vote(df: DataFrame, predictions: Sequence[str]) -> DataFrame:
    """Majority of 0/1 votes; a tie goes to the smaller label."""
    yes = sum((F.col(p).cast("int") for p in predictions), F.lit(0))
    return df.withColumn("prediction", F.when(yes * 2 > len(predictions), 1).otherwise(0))
