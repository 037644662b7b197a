"""Feature preparation of labelled and unlabelled records, model comparison, voting and submission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import family_size, first_letter, title_class
from ..learning.models import BUILDERS, COMPARED, bounded, score
from ..learning.search import fold_parts, score_table, two_stage_search
from ..operators.imputation import fill_group_median, group_size, hard_vote, soft_vote
from ..operators.metrics import classification_report, fold_summary
from ..session import cut_lineage


@dataclass(frozen=True)
class PassengerColumns:
    """Column names of a passenger list."""

    ident: str = "PassengerId"
    label: str = "Survived"
    klass: str = "Pclass"
    name: str = "Name"
    sex: str = "Sex"
    age: str = "Age"
    siblings: str = "SibSp"
    parents: str = "Parch"
    ticket: str = "Ticket"
    fare: str = "Fare"
    cabin: str = "Cabin"
    port: str = "Embarked"


NUMERIC = ["Pclass", "Age", "Fare", "FamilySize", "TicketGroupSize"]
CATEGORICAL = ["Sex", "Embarked", "Title", "Deck"]


def passenger_features(df: DataFrame, c: PassengerColumns = PassengerColumns()) -> DataFrame:
    """Deck, family size, title and ticket-group size; age filled with the median of its sex and class.

    Medians and group sizes come from the table itself, so training and test tables are prepared apart.
    """
    out = df.withColumns(
        {
            "Deck": first_letter(c.cabin),
            "FamilySize": family_size(c.siblings, c.parents),
            "Title": title_class(c.name),
        }
    ).drop(c.cabin, c.siblings, c.parents, c.name)
    out = fill_group_median(out, [c.sex, c.klass], c.age)
    return group_size(out, c.ticket, "TicketGroupSize").drop(c.ticket)


def fill_fare(df: DataFrame, train: DataFrame, c: PassengerColumns = PassengerColumns()) -> DataFrame:
    """Missing fares get the training table's median of their class."""
    return fill_group_median(df, [c.klass], c.fare, medians_of=train)


def fit_models(df: DataFrame, label: str, rows: int, params: dict[str, dict]) -> dict:
    """One fitted classifier per name in ``params``."""
    return {name: BUILDERS[name](label, rows, **p).fit(df) for name, p in params.items()}


def score_all(models: dict, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Every model's probability and prediction as columns p_<model> and y_<model>."""
    out = df
    for name, model in models.items():
        out = score(model, out, f"p_{name}", f"y_{name}")
    return out, [f"p_{m}" for m in models], [f"y_{m}" for m in models]


def vote(models: dict, df: DataFrame, how: str = "soft") -> DataFrame:
    """Soft (mean probability) or hard (majority) vote of the fitted models."""
    scored, probabilities, predictions = score_all(models, df)
    return soft_vote(scored, probabilities) if how == "soft" else hard_vote(scored, predictions)


def compare_models(
    df: DataFrame, label: str, rows: int, params: dict[str, dict], fold_column: str = "fold", folds: int = 5
) -> dict[str, list[dict]]:
    """Accuracy on every fold, with rows tested and right, of each classifier in ``params`` and of their soft and
    hard votes.

    A fold's classifiers are fitted once, on the other folds, and scored with both votes in one pass.
    """
    names = [*params, "soft_vote", "hard_vote"]
    out: dict[str, list[dict]] = {n: [] for n in names}
    for fold in range(folds):
        train, test = fold_parts(df, fold, fold_column, expanding=False)
        scored, probabilities, predictions = score_all(fit_models(train, label, rows, params), test)
        voted = soft_vote(scored, probabilities).withColumnRenamed("prediction", "y_soft_vote")
        voted = hard_vote(voted.drop("probability"), predictions).withColumnRenamed("prediction", "y_hard_vote")
        right = [F.count_if(F.col(f"y_{n}") == F.col(label)).alias(n) for n in names]
        counts = voted.agg(F.count(F.lit(1)).alias("_tested"), *right).first()
        for n in names:
            score_n = counts[n] / counts["_tested"] if counts["_tested"] else 0.0
            out[n].append({"candidate": 0, "fold": fold, "score": score_n, "tested": counts["_tested"], "right": counts[n]})
    return out


@dataclass(frozen=True)
class RecordJob:
    """What the whole job leaves: chosen parameters, fold comparison, reports on the training set, submission."""

    params: dict[str, dict]
    comparison: DataFrame
    reports: dict[str, DataFrame]
    submission: DataFrame


def record_job(
    known: DataFrame,
    unknown: DataFrame,
    ident: str,
    label: str,
    n_iter: int = 200,
    fixed: dict[str, dict] | None = None,
    folds: int = 5,
    how: str = "soft",
    max_fit_rows: int | None = None,
) -> RecordJob:
    """Two-stage search for each of the six classifiers, fold comparison with both votes, reports of the fitted
    models and votes on the training set, and the vote's prediction for the unlabelled records.

    ``known`` and ``unknown`` have feature vectors, ``known`` folds too. ``fixed`` overrides drawn parameters of a
    model. ``max_fit_rows`` bounds the labelled rows that searches and fits read, about; every unlabelled record is
    predicted.
    """
    spark = known.sparkSession
    fitted = known if max_fit_rows is None else cut_lineage(bounded(known, max_fit_rows, ident), "fitted")
    rows = fitted.count()
    params = {
        m: two_stage_search(fitted, m, label, rows, n_iter, (fixed or {}).get(m), folds=folds)[0] for m in COMPARED
    }
    scores = compare_models(fitted, label, rows, params, folds=folds)
    models = fit_models(fitted, label, rows, params)
    scored, probabilities, predictions = score_all(models, fitted)
    reports = {m: classification_report(scored, label, y) for m, y in zip(models, predictions)}
    reports["soft_vote"] = classification_report(soft_vote(scored, probabilities), label, "prediction")
    reports["hard_vote"] = classification_report(hard_vote(scored, predictions), label, "prediction")
    answer = vote(models, unknown, how).select(ident, F.col("prediction").alias(label))
    return RecordJob(params, fold_summary(score_table(spark, scores)), reports, answer)


def submission(model, df: DataFrame, ident: str, label: str) -> DataFrame:
    """(id, predicted label) of every row."""
    return score(model, df).select(ident, F.col("prediction").alias(label))
