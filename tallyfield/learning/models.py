"""Classifier builders that take the parameter names of the search ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import SEED, best_round
from .trees import Boosting, Forest, TreeEstimator, TreeModel

# Fixed value: share of the l1 part in an elastic-net penalty.
ELASTIC_SHARE = 0.15


def logistic(label: str, rows: int, C: float = 1.0, penalty: str = "l2", max_iter: int = 100) -> Estimator:
    """Logistic regression; C is the inverse penalty of the summed loss, Spark's is per row."""
    return LogisticRegression(
        labelCol=label,
        regParam=1.0 / (max(rows, 1) * C),
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        maxIter=int(max_iter),
        standardization=False,
    )


def linear(label: str, rows: int, alpha: float = 0.01, penalty: str = "l2", max_iter: int = 100) -> Estimator:
    """Linear log-loss classifier with an l2, l1 or mixed penalty, stopped by tolerance."""
    return LogisticRegression(
        labelCol=label,
        regParam=alpha,
        elasticNetParam={"l2": 0.0, "l1": 1.0, "elasticnet": ELASTIC_SHARE}[penalty],
        maxIter=int(max_iter),
        tol=1e-3,
        standardization=False,
    )


def random_forest(
    label: str, rows: int, n_estimators: int = 100, max_depth: int = 5, max_leaf_nodes: int | None = None, bootstrap: bool = True
) -> Estimator | TreeEstimator:
    """Forest of best cuts; with ``max_leaf_nodes`` its trees grow by the greatest gain first up to so many leaves."""
    if max_leaf_nodes is not None:
        return TreeEstimator(label, Forest(int(n_estimators), int(max_depth), int(max_leaf_nodes), bool(bootstrap), random_cuts=False))
    return RandomForestClassifier(
        labelCol=label,
        numTrees=int(n_estimators),
        maxDepth=int(max_depth),
        bootstrap=bool(bootstrap),
        featureSubsetStrategy="sqrt",
        seed=SEED,
    )


def extra_trees(
    label: str, rows: int, n_estimators: int = 100, max_depth: int = 5, max_leaf_nodes: int | None = None, bootstrap: bool = False
) -> TreeEstimator:
    """Extremely randomised trees: at each node one random cut of each of some features, by default on all rows."""
    return TreeEstimator(label, Forest(int(n_estimators), int(max_depth), max_leaf_nodes, bool(bootstrap)))


def boosting(
    label: str, rows: int, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.1, subsample: float = 1.0
) -> Estimator:
    return GBTClassifier(
        labelCol=label,
        maxIter=int(n_estimators),
        maxDepth=int(max_depth),
        stepSize=float(learning_rate),
        subsamplingRate=float(subsample),
        seed=SEED,
    )


def stopped_boosting(
    label: str,
    rows: int,
    n_estimators: int = 1000,
    max_depth: int = 5,
    learning_rate: float = 0.1,
    subsample: float = 1.0,
    colsample_bytree: float = 1.0,
    min_child_weight: int = 1,
    validation: str | None = None,
    validation_tol: float = 0.01,
) -> Estimator:
    """Boosting with a feature share per node and a smallest child, stopped on marked validation rows.

    Spark stops when the validation error improves by less than ``validation_tol``.
    """
    gbt = GBTClassifier(
        labelCol=label,
        maxIter=int(n_estimators),
        maxDepth=int(max_depth),
        stepSize=float(learning_rate),
        subsamplingRate=float(subsample),
        featureSubsetStrategy=str(float(colsample_bytree)) if colsample_bytree < 1 else "all",
        minInstancesPerNode=int(min_child_weight),
        validationTol=validation_tol,
        seed=SEED,
    )
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def regularised_boosting(
    label: str,
    rows: int,
    n_estimators: int = 1000,
    max_depth: int = 6,
    learning_rate: float = 0.3,
    subsample: float = 1.0,
    colsample_bytree: float = 1.0,
    min_child_weight: float = 1,
    reg_alpha: float = 0.0,
    reg_lambda: float = 1.0,
    gamma: float = 0.0,
    patience: int | None = None,
    weight: str | None = None,
    validation: str | None = None,
) -> TreeEstimator:
    """Boosting with penalties on leaf weights and splits, a share of the columns per tree, and patience in rounds on
    the rows that ``validation`` marks."""
    whole = {"n_estimators": int(n_estimators), "max_depth": int(max_depth), "patience": patience}
    shares = {"learning_rate": learning_rate, "subsample": subsample, "colsample_bytree": colsample_bytree}
    params = Boosting(**whole, **shares, min_child_weight=min_child_weight, reg_alpha=reg_alpha, reg_lambda=reg_lambda, gamma=gamma)
    return TreeEstimator(label, params, weight, validation)


def weighted_boosting(df: DataFrame, label: str, weight: str, min_child_weight: float = 1, **params) -> Estimator:
    """Boosting on rows that stand for ``weight`` rows each; the smallest child is measured by weight too."""
    total = df.agg(F.sum(weight)).first()[0] or 1
    gbt = stopped_boosting(label, 0, **params).setWeightCol(weight)
    return gbt.setMinWeightFractionPerNode(min(0.499, float(min_child_weight) / float(total)))


def spread(df: DataFrame, weight: str, parts: int = 8) -> DataFrame:
    """Rows of weight over 1 as up to ``parts`` rows, so that sampling rows does not take or leave all of them at once."""
    shares = F.least(F.lit(parts), F.greatest(F.lit(1), F.floor(weight))).cast("int")
    return df.withColumn("_part", F.explode(F.sequence(F.lit(1), shares))).withColumn(weight, F.col(weight) / shares).drop("_part")


def bounded(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of their keys; for fitting only, never for results."""
    share = rows / max(df.count(), 1)
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < int(share * (1 << 20)))


def patient_boosting(df: DataFrame, label: str, validation: str, trees: int, patience: int, params: dict, weight: str | None = None):
    """Boosting on the rows that ``validation`` does not mark, cut to the best round on those that it marks.

    Rounds are fitted ``2 * patience`` at a time more until the rule stops; the same seed gives the same first trees.
    With ``weight``, a row stands for that many rows.
    """
    train, val = df.where(~F.col(validation)), df.where(validation)

    def fit(rounds: int):
        if weight is None:
            return stopped_boosting(label, 0, n_estimators=rounds, **params).fit(train)
        return weighted_boosting(train, label, weight, n_estimators=rounds, **params).fit(spread(train, weight))

    if val.isEmpty():
        return fit(trees)
    tried = min(trees, 2 * patience)
    while True:
        model = fit(tried)
        kept = best_round(model.evaluateEachIteration(val), patience)
        if tried == trees or kept + patience <= tried:
            break
        tried = min(trees, 2 * tried)
    return model if kept == tried else fit(kept)


BUILDERS: dict[str, Callable[..., Estimator | TreeEstimator]] = {
    "linear": linear,
    "logistic": logistic,
    "random_forest": random_forest,
    "extra_trees": extra_trees,
    "boosting": boosting,
    "stopped_boosting": stopped_boosting,
    "regularised_boosting": regularised_boosting,
}
#: The classifiers that a whole job searches, compares and lets vote.
COMPARED = ("linear", "logistic", "random_forest", "extra_trees", "boosting", "regularised_boosting")


def score(model, df: DataFrame, probability: str = "probability", prediction: str = "prediction") -> DataFrame:
    """Input columns plus the probability of class 1 and the 0/1 prediction."""
    keep = [c for c in df.columns if c not in (probability, prediction)]
    if isinstance(model, TreeModel):
        scored = df.select(*keep, model.probability().alias(f"_{probability}"))
        scored = scored.withColumn(f"_{prediction}", (F.col(f"_{probability}") > 0.5).cast("int"))
        return scored.withColumnsRenamed({f"_{probability}": probability, f"_{prediction}": prediction})
    out = model.transform(df.select(*keep))
    p = vector_to_array(F.col(model.getProbabilityCol()))[1]
    return out.select(
        *keep, p.alias(f"_{probability}"), F.col(model.getPredictionCol()).cast("int").alias(f"_{prediction}")
    ).withColumnsRenamed({f"_{probability}": probability, f"_{prediction}": prediction})
