"""Nested order JSON: one object or an array of objects per file, flattened to one row per item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import order_day
from .arrays import read_json_arrays

ORDER_SCHEMA = "id bigint, orderTime string, items array<struct<id:bigint,name:string,amount:bigint>>"
LINE_COLUMNS = ["order_id", "order_orderTime", "id", "name", "amount"]


def read_orders(spark: SparkSession, path: str, schema: str | T.StructType = ORDER_SCHEMA, documents: bool = False) -> DataFrame:
    """One order per line or, with ``documents``, files that are one array or object each; both are split into tasks."""
    return read_json_arrays(spark, path, schema) if documents else spark.read.schema(schema).json(path)


def flatten_orders(orders: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per item: scalar order fields as ``order_*``, item fields as they are, the order's UTC day.

    Orders without items disappear. Wanted columns the data does not have are null.
    """
    keep = keep or LINE_COLUMNS
    scalars = [
        f.name
        for f in orders.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    ]
    flat = orders.select(
        *[F.col(c).alias(f"order_{c}") for c in scalars], F.explode("items").alias("_item")
    ).select(*[f"order_{c}" for c in scalars], "_item.*")
    have = set(flat.columns)
    out = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in keep]
    day = order_day("order_orderTime") if "order_orderTime" in have else F.lit(None).cast("date")
    return flat.select(out[0], day.alias("date"), *out[1:])
