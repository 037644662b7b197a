"""Session set-up and the shared folder used to cut lineage and hand tables over."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "tallyfield", cpus: str | int = "*", memory: str = "12g", partitions: int | None = None
) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own session."""
    width = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or width))
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture costs a JVM round trip per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators count on.

    Joins carry no broadcast hints: AQE picks a broadcast only for a side it has measured below
    ``spark.sql.autoBroadcastJoinThreshold`` and splits hot keys of the other joins.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


#: Bytes that a task reads of files and of a shuffle, about, and bytes of tables for each partition that a shuffle is dealt into.
#: What a task reads of files is what Spark gives it of small tables (its cost of opening a file), so that it does not grow.
READ_BYTES, SHUFFLE_BYTES, DEALT_BYTES = 4 << 20, 8 << 20, 2 << 20


def bytes_below(spark: SparkSession, path: str) -> int:
    """Bytes of the files at a path, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength())


def size_tasks(spark: SparkSession, folder: str) -> SparkSession:
    """Let what a task holds stay the same while the tables of a folder grow: tasks become more, not larger.

    Shuffles are dealt into a number of partitions that follows from the bytes of the tables, and AQE joins small ones up
    to SHUFFLE_BYTES. Settings that ask for smaller tasks are kept.
    """
    conf = spark.conf
    dealt = max(int(conf.get("spark.sql.shuffle.partitions")), -(-bytes_below(spark, folder) // DEALT_BYTES))
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(dealt))
    bounds = {
        "spark.sql.files.maxPartitionBytes": READ_BYTES,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_BYTES,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 4 * SHUFFLE_BYTES,
    }
    for key, most in bounds.items():
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
        conf.set(key, str(min(int(now), most)))
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tallyfield-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables handed from job to job inside the block go to a folder of their own, deleted at its end.

    The result has to be written, or collected, within the block: it still reads these tables.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path for a table handed from one job to the next, below the shared folder or the open scratch folder."""
    folder = _scratch[-1] if _scratch else shared_dir(spark).rstrip("/")
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "kept", raw: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    ``raw`` writes plain values, so that the size on disk is about the size in memory.

    The table outlives the executors, so losing one changes nothing, and it carries real sizes for the
    join planner, which a checkpointed RDD does not.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write
    if raw:
        writer = writer.option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str = "kept") -> tuple[DataFrame, int]:
    """As :func:`cut_lineage`, with the bytes that the written files have."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), bytes_below(spark, path)
