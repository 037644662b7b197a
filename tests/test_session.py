import pytest

from tallyfield import session as E


class Stub:
    """A session that names no shared folder."""

    def __init__(self, master, folder=None):
        self.master, self.folder, self.sparkContext, self.conf = master, folder, self, self
        self.kept = None

    def getConf(self):
        return self

    def get(self, name, default=None):
        return self.folder if name == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.kept

    def setCheckpointDir(self, path):
        self.kept = path


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError):
        E.shared_dir(Stub("spark://host:7077"))


def test_the_named_folder_is_used():
    stub = Stub("spark://host:7077", "hdfs:///shared")
    assert E.shared_dir(stub) == "hdfs:///shared" == stub.kept
    assert E.scratch_path(stub, "x").startswith("hdfs:///shared/x-")


def test_written_lineage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, "a", None)], "i int, t string, l array<int>")
    kept = E.cut_lineage(df)
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert kept.inputFiles()


def test_scratch_tables_go_with_their_block(spark, tmp_path):
    import os

    df = spark.range(10)
    with E.scratch(spark) as folder:
        E.cut_lineage(df).write.parquet(str(tmp_path / "out"))
        here = folder.removeprefix("file:")
        assert os.listdir(here)
    assert not os.path.exists(here) and spark.read.parquet(str(tmp_path / "out")).count() == 10
    assert "scratch-" not in E.scratch_path(spark, "x")


def test_shuffles_are_dealt_by_the_bytes_of_the_tables(spark, tmp_path, monkeypatch):
    keys = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": None,
        "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            if v:
                spark.conf.set(k, v)
        spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
        size = E.bytes_below(spark, str(tmp_path))
        dealt = []
        for bytes_each in (size, size // 50):
            monkeypatch.setattr(E, "DEALT_BYTES", bytes_each)
            E.size_tasks(spark, str(tmp_path))
            dealt.append(int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")))
        assert dealt[0] == int(spark.conf.get("spark.sql.shuffle.partitions")) and dealt[1] >= 50
        # smaller tasks that were asked for stay small, larger ones are bounded
        assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) == 4 << 20
        assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == E.SHUFFLE_BYTES
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_task_reads_no_more_of_a_large_table_than_of_a_small_one(spark, tmp_path):
    key, small = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.openCostInBytes")
    keys = [key, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    keys.append("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(key, "128m")
        E.size_tasks(spark, str(tmp_path))
        assert int(spark.conf.get(key)) <= spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(small)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
