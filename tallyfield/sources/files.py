"""Parquet, CSV, text and JSON tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null
from ..operators.joins import upsert
from ..operators.ordering import laid_out


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet table of a folder, NaN read as null; a declared schema saves the job that would look it up."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.parquet(f"{folder.rstrip('/')}/{name}.parquet"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Byte-order mark and blank lines are skipped, inner quotes are kept as they are.

    NaN is read as null. With a schema the file is read once; without one the types are inferred by a first pass.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is not None:
        return nan_to_null(reader.schema(schema).csv(path))
    df = reader.option("inferSchema", True).csv(path)
    return nan_to_null(df.toDF(*[c.lstrip("﻿") for c in df.columns]))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, line: str, order: Sequence[str]) -> None:
    """Text report, one line per row, in the given order across the part files."""
    laid_out(df, order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_json(spark: SparkSession, old_path: str, new_rows: DataFrame, key: str, path: str) -> DataFrame:
    """Old JSON dimension plus new rows (new ones win), written to a new path."""
    old = spark.read.schema(new_rows.schema).json(old_path)
    write_json(upsert(old, new_rows, [key]), path)
    return spark.read.schema(new_rows.schema).json(path)
