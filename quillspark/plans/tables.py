"""Access to the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of at most so many bytes may be dealt out anew; larger ones are read as they are split.
SMALL_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of at most SMALL_BYTES that is read in fewer splits than there are cores is dealt out.

    So what is shuffled here never exceeds that size, however many cores there are."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """rows of a file scan, dealt to all cores if they are few bytes in few splits."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if size <= small and rows.rdd.getNumPartitions() < cores else rows
