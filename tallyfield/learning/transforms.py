"""Fitted column transformer: imputation, scaling, one-hot encoding, one feature vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.imputation import scaling_table
from ..operators.profiles import most_frequent


def _number(x: float | None) -> str:
    return "cast(null as double)" if x is None else f"double('{x!r}')"


def _text(x: str | None) -> str:
    if x is None:
        return "cast(null as string)"
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column from one pass; one row per column reaches the driver."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    tall = train.select(pairs.alias("_p")).select("_p.column", "_p.value")
    return {r["column"]: r["value"] for r in most_frequent(tall, "value", ["column"]).collect()}


def fit_features(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], out: str = "features"
) -> PipelineModel:
    """Learn everything on the training table; the result transforms any table and can be saved.

    Numbers are centred and divided by the population std, texts filled with the training mode and
    one-hot encoded over the sorted training categories; an unseen category raises an error.
    """
    learned = scaling_table(train, numeric).first()
    filled = modes(train, categorical) if categorical else {}
    parts = [
        f"(cast(`{c}` as double) - {_number(learned[f'{c}_mean'])}) / {_number(learned[f'{c}_std'])} as `{c}_scaled`"
        for c in numeric
    ]
    parts += [f"coalesce(cast(`{c}` as string), {_text(filled.get(c))}) as `{c}_filled`" for c in categorical]
    stages = [SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__")]
    if categorical:
        stages.append(
            StringIndexer(
                inputCols=[f"{c}_filled" for c in categorical],
                outputCols=[f"{c}_index" for c in categorical],
                stringOrderType="alphabetAsc",
                handleInvalid="error",
            )
        )
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}_index" for c in categorical],
                outputCols=[f"{c}_hot" for c in categorical],
                dropLast=False,
            )
        )
    stages.append(
        VectorAssembler(
            inputCols=[f"{c}_scaled" for c in numeric] + [f"{c}_hot" for c in categorical], outputCol=out
        )
    )
    return Pipeline(stages=stages).fit(train)
