"""Null-safe equi-joins on shared key columns, and join sides of known size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join where null keys meet null keys; the key columns appear once.

    The right keys are renamed first, so both sides may come from the same table. ``<=>`` is planned as
    a hash or sort-merge equi-join like ``=``.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def measured(df: DataFrame) -> DataFrame:
    """Write a derived join side so that the planner sees its real size.

    The size guessed for an aggregate or a join is near that of the whole table, and the other side would
    be shuffled for it. Once written uncompressed, a side below ``spark.sql.autoBroadcastJoinThreshold`` is broadcast and
    the big side stays where it is; a larger one is shuffled as usual.
    """
    return cut_lineage(df, "side", raw=True)
