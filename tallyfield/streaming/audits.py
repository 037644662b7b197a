"""The audit report kept up to date over batches of sales.

Each micro-batch files its summaries; the report over all that has arrived is made from the merged summaries, so
repeats and conflicts between batches count like those within one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import SalesColumns
from ..plans.audit import merge, report
from ..session import scratch_path


def audit_stream(
    arriving: DataFrame, summary: Callable[[DataFrame], DataFrame], filed: str, progress: str, once: bool = True
):
    """Start a query that summarises each micro-batch and files the result under the batch number.

    A batch that is replayed after a failure overwrites its own file, so every batch counts once.
    ``once`` drains what is there and ends; otherwise the query keeps running.
    """

    def file_summary(batch: DataFrame, number: int) -> None:
        summary(batch).write.mode("overwrite").parquet(f"{filed}/batch={number}")

    writer = arriving.writeStream.foreachBatch(file_summary).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drain(spark: SparkSession, arriving: DataFrame, summary: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Summarise everything that has arrived and return what was filed, one set of rows per batch."""
    filed = scratch_path(spark, "audit-summaries")
    running = audit_stream(arriving, summary, filed, scratch_path(spark, "audit-progress"))
    running.awaitTermination()
    return spark.read.parquet(filed)


def combine(filed: DataFrame, sites: DataFrame, articles: DataFrame, columns: SalesColumns = SalesColumns()) -> DataFrame:
    """The audit report over all batches."""
    return report(merge(filed, columns), sites, articles, columns)
