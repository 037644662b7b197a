"""Evaluation of scored tables: binary, multi-class and multi-label."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import join_same
from .ordering import running_totals


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where undefined."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def accuracy(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    return scored.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def confusion(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts per (truth, prediction) and the error share of each truth row, 0 on the diagonal."""
    cells = scored.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("count"))
    rows = cells.groupBy(label).agg(F.sum("count").alias("_row"))
    error = F.when(F.col(label) == F.col(prediction), 0.0).otherwise(F.col("count") / F.col("_row"))
    return join_same(cells, rows, [label]).select(label, prediction, "count", error.alias("error_share"))


def classification_report(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    cells = scored.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("t").cast("string").alias("class"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("d"), hit.alias("tp")),
        F.struct(F.col("p").cast("string").alias("class"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("d"), F.lit(0).cast("bigint").alias("tp")),
    )
    sums = (
        cells.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("s").alias("support"), F.sum("d").alias("_d"), F.sum("tp").alias("_tp"))
    )
    per = sums.select(
        "class",
        _ratio(F.col("_tp"), F.col("_d")).alias("precision"),
        _ratio(F.col("_tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("_tp"), F.col("_d") + F.col("support")).alias("f1"),
        "support",
        "_tp",
    )
    total = F.sum("support")

    def averaged(name: str, f) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            f("precision").alias("precision"),
            f("recall").alias("recall"),
            f("f1").alias("f1"),
            total.alias("support"),
        )

    acc = F.sum("_tp") / total
    rows = per.agg(
        F.array(
            averaged("accuracy", lambda _: acc),
            averaged("macro avg", lambda k: F.avg(k)),
            averaged("weighted avg", lambda k: F.sum(F.col(k) * F.col("support")) / total),
        ).alias("_a")
    ).select(F.inline("_a"))
    return per.drop("_tp").unionByName(rows)


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve: positives above negatives, ties worth half.

    Rows are summed per distinct score before they are ordered; the order is laid over range slices.
    """
    positive = F.col(label) == 1
    steps = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg")
    )
    laid = running_totals(steps, [], [score], "_neg", "_below", "_all")
    won = F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))
    return laid.agg(
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), F.sum(won).alias("_won")
    ).select(
        "positives",
        "negatives",
        (F.col("_won") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auc"),
    )


def _hits(truth: str, prediction: str) -> list[Column]:
    t, p = F.col(truth) > 0, F.col(prediction) > 0
    return [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
    ]


def f1_ratio() -> Column:
    """F1 from tp, fp and fn; empty against empty is 0."""
    return _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def jaccard_ratio() -> Column:
    """Jaccard from tp, fp and fn; empty against empty is 1."""
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(union == 0, F.lit(1.0)).otherwise(F.col("tp") / F.nullif(union, F.lit(0)))


def label_f1(scored: DataFrame, category: str, truth: str, prediction: str) -> DataFrame:
    """F1 and support per category."""
    return scored.groupBy(category).agg(*_hits(truth, prediction)).select(
        category, f1_ratio().alias("f1"), (F.col("tp") + F.col("fn")).alias("support")
    )


def weighted_f1(scored: DataFrame, category: str, truth: str, prediction: str) -> DataFrame:
    """Support-weighted F1 over the categories; undefined values count as 0."""
    return weigh_f1(label_f1(scored, category, truth, prediction))


def weigh_f1(per: DataFrame) -> DataFrame:
    """Mean of ``f1`` weighted by ``support``."""
    return per.agg(
        F.coalesce(F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0)).alias("f1")
    )


def per_unit(scored: DataFrame, unit: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """tp / fp / fn, F1 (empty against empty is 0) and Jaccard (empty against empty is 1) per order."""
    sums = scored.groupBy(*unit).agg(*_hits(truth, prediction))
    return sums.select(*unit, "tp", "fp", "fn", f1_ratio().alias("f1"), jaccard_ratio().alias("jaccard"))


def basket_scores(scored: DataFrame, unit: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """Sample-averaged F1, mean Jaccard, mean predicted and mean actual width."""
    return mean_scores(per_unit(scored, unit, truth, prediction))


def mean_scores(units: DataFrame) -> DataFrame:
    """Means over the orders of :func:`per_unit`."""
    return units.agg(
        F.count(F.lit(1)).alias("orders"),
        F.avg("f1").alias("f1_samples"),
        F.avg("jaccard").alias("jaccard"),
        F.avg(F.col("tp") + F.col("fp")).alias("predicted_width"),
        F.avg(F.col("tp") + F.col("fn")).alias("actual_width"),
    )


# The thresholds tried, 0.05 to 0.49 in steps of 0.01, and the one kept without data.
THRESHOLDS = [float(t) for t in np.arange(0.05, 0.50, 0.01)]
DEFAULT_THRESHOLD = 0.5


def _steps() -> Column:
    return F.array(*[F.lit(t) for t in THRESHOLDS])


def score_level(probability: str) -> Column:
    """Number of the highest threshold that the score reaches, -1 if none."""
    steps, last = _steps(), len(THRESHOLDS) - 1
    p = F.col(probability).cast("double")
    guess = F.greatest(F.lit(0), F.least(F.lit(last), F.floor((p - 0.05) / 0.01))).cast("int")
    return (
        F.when(p < F.get(steps, guess), guess - 1)
        .when((guess < last) & (p >= F.get(steps, guess + 1)), guess + 1)
        .otherwise(guess)
    )


def threshold_curve(scored: DataFrame, unit: Sequence[str], truth: str, probability: str) -> DataFrame:
    """Mean predicted width at every threshold next to the mean actual width.

    Each score is filed under the highest threshold it reaches, so the rows are counted once and only
    the 45 counts are cumulated.
    """
    filed = scored.select(*unit, truth, score_level(probability).alias("_level"))
    counts = filed.groupBy("_level").agg(F.count(F.lit(1)).alias("_c"))
    base = filed.agg(
        F.count_distinct(*unit).alias("orders"), F.count_if(F.col(truth) > 0).alias("bought")
    )
    return cumulated_curve(counts, base, base)


def cumulated_curve(counts: DataFrame, orders: DataFrame, bought: DataFrame) -> DataFrame:
    """The curve from scores per level (``_level``, ``_c``) and one row each with ``orders`` and ``bought``."""
    ladder = counts.sparkSession.range(len(THRESHOLDS)).select(
        F.col("id").cast("int").alias("_level"), F.get(_steps(), F.col("id").cast("int")).alias("threshold")
    )
    # 45 rows: every level, cumulated from the top
    above = Window.orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0)
    tall = join_same(ladder, counts, ["_level"]).withColumn(
        "_pred", F.sum(F.coalesce("_c", F.lit(0))).over(above)
    )
    n = F.nullif(orders.select("orders").scalar(), F.lit(0))
    predicted = F.col("_pred") / n
    actual = bought.select("bought").scalar() / n
    return tall.select(
        "threshold",
        predicted.alias("predicted_width"),
        actual.alias("actual_width"),
        F.abs(predicted - actual).alias("gap"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """Threshold with the smallest gap, the lowest on ties, the default if there is nothing to go by."""
    best = F.min_by("threshold", F.struct("gap", "threshold"))
    return curve.where(F.col("gap").isNotNull()).agg(
        F.coalesce(best, F.lit(DEFAULT_THRESHOLD)).alias("threshold"), F.min("gap").alias("gap")
    )


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of the fold scores of each model's best candidate.

    ``scores`` has model, candidate, fold and score; the best candidate has the highest mean, the
    earliest on ties.
    """
    per = scores.groupBy("model", "candidate").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("folds")
    )
    best = F.max_by(F.struct("candidate", "mean", "std", "folds"), F.struct("mean", -F.col("candidate")))
    return per.groupBy("model").agg(best.alias("_b")).select("model", "_b.*")
