import pytest

from quillspark import scratch
from quillspark.plans import tables


class _Cluster:
    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return _Cluster.folder

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

    folder = None


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        scratch.shared_folder(_Cluster)
    _Cluster.folder = "store://shared/"
    assert scratch.shared_folder(_Cluster) == "store://shared"


def test_only_small_tables_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    rows = spark.read.parquet(str(tmp_path / "t.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(rows).rdd.getNumPartitions() == cores
    assert tables.spread(rows, small=10).rdd.getNumPartitions() == rows.rdd.getNumPartitions() < cores
