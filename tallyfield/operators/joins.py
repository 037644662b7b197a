"""Lookups, anti-joins, key differences, unions and upserts.

No join is hinted. Catalyst and AQE broadcast a side only when its measured size is below the session's
threshold; otherwise the join shuffles and AQE splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import zone_differs
from .keys import join_same, measured


def unique_side(dim: DataFrame, key: str, take: dict[str, str]) -> DataFrame:
    """A dimension as the right side of a lookup: ``_dim_key`` and the wanted columns (output name -> column).

    A repeated key would multiply the rows that look it up; it raises an error that names it, checked while the
    join runs. Null keys match nothing and are left out.
    """
    copies = (
        dim.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_dim_key"))
        .agg(F.count(F.lit(1)).alias("_copies"), *[F.max(src).alias(out) for out, src in take.items()])
    )
    repeated = F.raise_error(F.concat(F.lit("repeated lookup key "), F.col("_dim_key").cast("string")))
    key_kind = dict(copies.dtypes)["_dim_key"]
    checked = F.when(F.col("_copies") > 1, repeated.cast(key_kind)).otherwise(F.col("_dim_key"))
    return copies.select(checked.alias("_dim_key"), *take)


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, take: dict[str, str]) -> DataFrame:
    """Left join that brings dimension columns under new names (``take``: output name -> dim column)."""
    return df.join(unique_side(dim, dim_key, take), F.col(key) == F.col("_dim_key"), "left").drop("_dim_key")


def map_values(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, out: str) -> DataFrame:
    """Scalar lookup that refuses a dimension with repeated keys."""
    return lookup(df, dim, key, dim_key, {out: value})


def rows_with_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key tuple is listed; null keys match null keys."""
    return join_same(df, measured(keys_df.select(*keys)), keys, "left_semi")


def orphans(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Rows whose key is absent from the other table; a null key is absent too."""
    # AQE cannot split the right side of an anti join, so a hot key is reduced to one row a task before the shuffle
    side = dim.select(F.col(dim_key).alias("_dim_key")).distinct()
    return df.join(side, F.col(key) == F.col("_dim_key"), "left_anti")


def drop_keys(df: DataFrame, dim: DataFrame, key: str, dim_key: str, where: Column) -> DataFrame:
    """Drop rows whose key belongs to the selected part of a dimension."""
    return orphans(df, dim.where(where), key, dim_key)


def attribute_mismatch(
    df: DataFrame, dim: DataFrame, key: str, dim_key: str, attribute: str, dim_attribute: str
) -> DataFrame:
    """Rows whose attribute differs from the dimension's; an unknown key counts as different."""
    looked = lookup(df, dim, key, dim_key, {"expected": dim_attribute})
    return looked.where(zone_differs(attribute, "expected"))


def new_keys(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Distinct keys seen in the rows but not in the dimension."""
    return orphans(df.select(key).where(F.col(key).isNotNull()).distinct(), dim, key, dim_key)


def align(left: DataFrame, right: DataFrame, keys: Sequence[str], zeros: Sequence[str] = ()) -> DataFrame:
    """Bring feature blocks side by side on their key; listed columns read 0 where the block has no row."""
    out = join_same(left, right, keys, "left")
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in zeros else F.col(c) for c in out.columns])


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples on the left that the right does not have."""
    return join_same(left.select(*keys).distinct(), right.select(*keys).distinct(), keys, "left_anti")


def _settle(df: DataFrame, keys: Sequence[str], pick) -> DataFrame:
    """One row per key: rows of unrepeated keys as they are, of repeated ones ``pick(rest)``.

    The pass over the whole table is a count per key; only rows of repeated keys reach the sort-based choice.
    """
    rest = [c for c in df.columns if c not in keys]
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1).select(*keys)
    once = join_same(df, repeated, keys, "left_anti")
    chosen = join_same(df, repeated, keys, "left_semi").groupBy(*keys).agg(pick(rest).alias("_row"))
    return once.unionByName(chosen.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first under the order; combines on the map side."""
    return _settle(df, keys, lambda rest: F.min_by(F.struct(*rest), F.struct(*order)))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new rows of a dimension together; a new row replaces the old one of its key.

    Of several old or several new rows of a key the largest one counts, so the result is the same every time.
    """

    def largest(df: DataFrame) -> DataFrame:
        return _settle(df, keys, lambda rest: F.max(F.struct(*rest)))

    fresh = largest(new.select(*old.columns))
    return join_same(largest(old), fresh.select(*keys), keys, "left_anti").unionByName(fresh)
