"""Continuous evaluation: new case files are read as they come, done cases are skipped, results appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import metrics
from quillspark.functions import text as X
from quillspark.operators import relational


def result_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """OCR result lines as a stream; malformed lines give no code_id and drop out."""
    rows = spark.readStream.schema(schemas.OCR_RESULT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.where("code_id IS NOT NULL")


def score_stream(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Stream-static join with the ground truth and the character error rate of each record."""
    ref, hyp = X.without_blank_lines(F.col("code")), X.without_blank_lines(F.col("text"))
    return relational.score_inputs(results, truth).select("code_id", "ratio", "model", metrics.cer(ref, hyp).alias("cer"))


def append_new(stream: DataFrame, path: str, checkpoint: str, keys=("code_id", "ratio"), once: bool = True):
    """Write each batch's unseen keys to a Parquet table; a batch that is replayed writes nothing twice.

    The checkpoint remembers files, the anti join remembers cases; equal keys in one batch are written once."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(list(keys))
        try:
            seen = batch.sparkSession.read.parquet(path)
        except Exception as e:  # the first batch finds no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            fresh = relational.pending(fresh, seen, keys)
        fresh.write.mode("append").parquet(path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ratio_counts(stream: DataFrame, watermark: str = "10 minutes", window: str = "1 hour", at: str = "ts") -> DataFrame:
    """Results of each ratio in event-time windows; late rows beyond the watermark are left out."""
    return stream.withWatermark(at, watermark).groupBy(F.window(at, window), "ratio").agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("cer"))
