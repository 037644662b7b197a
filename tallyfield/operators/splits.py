"""Chronological splits and fold assignment as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .baskets import LineColumns, distinct_days, trained_positions
from .keys import join_same, measured
from .ordering import number_rows


def _tail_counts(n_days: Column, n_rows: Column, test_size: float, val_size: float) -> tuple[Column, Column]:
    """Test rows from the number of days, validation rows from what remains; both truncate."""
    n_test = F.floor(n_days * F.lit(float(test_size)))
    n_val = F.greatest(F.lit(1), F.floor((n_rows - n_test) * F.lit(float(val_size))))
    return n_test, n_val


def _role(place: Column, n: Column, n_test: Column, n_val: Column) -> Column:
    return (
        F.when(place > n - n_test, F.lit("test"))
        .when(place > n - n_test - n_val, F.lit("val"))
        .otherwise(F.lit("train"))
    )


def split_by_customer(
    features: DataFrame,
    sequence: DataFrame,
    c: LineColumns = LineColumns(),
    test_size: float = 0.1,
    val_size: float = 0.2,
    target_offset: int = 1,
) -> DataFrame:
    """train / val / test per customer: the last trained orders are the test set.

    A customer with too few days for one test order has none (a zero-length tail would otherwise read
    as "everything"). Positions come from the order sequence, so nothing is sorted again.
    """
    days = distinct_days(sequence, c)
    rows = features.where(trained_positions(target_offset))
    joined = join_same(rows, days, [c.customer], "inner")
    n_rows = F.col("n") - 2 - target_offset
    n_test, n_val = _tail_counts(F.col("n_days"), n_rows, test_size, val_size)
    return joined.withColumn("role", _role(F.col("seq") - 2, n_rows, n_test, n_val)).drop("n_days")


def split_by_time(
    features: DataFrame,
    sequence: DataFrame,
    c: LineColumns = LineColumns(),
    test_size: float = 0.1,
    val_size: float = 0.2,
    target_offset: int = 1,
) -> DataFrame:
    """train / val / test over all customers on one time line, with the row's place in it.

    ``test_size=0`` makes a train / val split. ``n_train`` is the length of the training head.
    """
    n_days = sequence.agg(F.count_distinct(c.day).alias("n")).first()["n"]
    if test_size > 0 and int(n_days * test_size) == 0:
        raise ValueError("too few days for a test set; a zero-length tail would take every row")
    rows = features.where(trained_positions(target_offset))
    placed = number_rows(rows, [], [c.day, c.customer, c.order], "place", "n_rows")
    n_test, n_val = _tail_counts(F.lit(n_days), F.col("n_rows"), test_size, val_size)
    return placed.withColumns(
        {
            "role": _role(F.col("place"), F.col("n_rows"), n_test, n_val),
            "n_train": F.col("n_rows") - n_test - n_val,
        }
    )


def time_series_folds(placed: DataFrame, place: str = "place", n_rows: str = "n_rows", folds: int = 5) -> DataFrame:
    """Expanding folds: ``test_fold`` is the fold that tests on the row, -1 for rows that only train.

    Fold f trains on rows with a smaller ``test_fold``; one column replaces five copies of the table.
    """
    size = F.floor(F.col(n_rows) / (folds + 1))
    start = F.col(n_rows) - folds * size
    at = F.col(place) - 1
    fold = F.when(at < start, F.lit(-1)).otherwise(F.floor((at - start) / F.nullif(size, F.lit(0))))
    return placed.withColumn("test_fold", fold.cast("int"))


def fold_roles(assigned: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, role) rows of an expanding assignment: what each fold trains and tests on."""
    out = assigned.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col("test_fold") == F.col("fold"), "test").when(F.col("test_fold") < F.col("fold"), "train")
    return out.withColumn("role", role).where(F.col("role").isNotNull())


def stratified_folds(df: DataFrame, label: str, order: Sequence[str], folds: int = 5) -> DataFrame:
    """Unshuffled stratified folds, remainders dealt over the label-sorted rows.

    Rows sorted by label (labels in order of first appearance) are dealt to the folds in turn; a fold
    then takes that many rows of each label, in row order.
    """
    numbered = number_rows(df, [label], order, "_r", "_n")
    classes = numbered.groupBy(label).agg(F.max("_n").alias("_size"), F.min(F.struct(*order)).alias("_first"))
    # one row per label value
    ahead = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(
        label, "_size", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start")
    )
    joined = join_same(numbered, measured(classes), [label], "inner")
    start, end = F.col("_start"), F.col("_start") + F.col("_size")
    dealt, fold = F.lit(0), F.lit(0)
    for i in range(folds - 1):
        dealt = dealt + F.floor((end - 1 - i) / folds) - F.floor((start - 1 - i) / folds)
        fold = fold + F.when(F.col("_r") > dealt, 1).otherwise(0)
    return joined.select(*df.columns, fold.cast("int").alias("fold"))
