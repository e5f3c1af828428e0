"""Readers of the pipelines' files into DataFrames. All go through Spark's readers, so any file system works."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text as X
from quillspark.operators import relational, retrieval


def code_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, code, language); one row per whole file."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code")).withColumn("language", X.language_of(F.col("path")))


def code_or_sample(spark: SparkSession, code: str | None = None, path: str | None = None, sample: str = "") -> DataFrame:
    """A given string, else a file, else a sample; blank input raises ValueError."""
    if code is None and path is not None:
        rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("code"))
        if rows.where(~X.is_blank(F.col("code"))).isEmpty():
            raise ValueError(f"{path} is empty")
        return rows
    code = sample if code is None else code
    if not code.strip():
        raise ValueError("no code given")
    return spark.createDataFrame([(code,)], "code string")


def ground_truth(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON array of {id, code}; of equal ids the one furthest in the file wins, the first path that has any."""
    for path in paths:
        try:
            rows = spark.read.schema(schemas.GROUND_TRUTH).option("multiLine", True).json(path)
        except Exception as e:  # a path that is not there falls through to the next
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        placed = rows.withColumn("_p", F.monotonically_increasing_id())
        return relational.last_by_position(placed, "id", "_p").select(F.col("id").alias("code_id"), "code")
    raise FileNotFoundError(", ".join(paths))


def ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of OCR records; blank and malformed lines are dropped."""
    return spark.read.schema(schemas.OCR_RESULT).option("mode", "DROPMALFORMED").json(path).where("code_id IS NOT NULL")


def done_set(spark: SparkSession, path: str) -> DataFrame:
    """Keys of finished cases, by image path and by id and ratio."""
    return relational.done_keys(spark.read.schema(schemas.OCR_RESULT).option("mode", "DROPMALFORMED").json(path))


def image_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Image files below a directory with size and time, and their bytes if wanted."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(X.is_image(F.col("path")))
    return rows if content else rows.drop("content")


def latest_file(spark: SparkSession, path: str, glob: str = "*.jsonl") -> str | None:
    """The file of the newest modification time."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.agg(F.max_by("path", "modificationTime")).first()[0]


def qa_items(spark: SparkSession, path: str, limit: int | None = 200) -> DataFrame:
    """QA items of a JSON array with a context, the first ``limit`` by file order, options as text."""
    rows = spark.read.schema(schemas.QA_ITEM).option("multiLine", True).json(path).withColumn("pos", F.monotonically_increasing_id())
    return qa_rows(rows, limit)


def qa_rows(rows: DataFrame, limit: int | None = 200) -> DataFrame:
    kept = rows.where(~X.is_blank(F.col("context")))
    kept = kept if limit is None else relational.first_rows(kept, "pos", limit)
    return kept.select(F.col("pos").alias("id"), "repo", F.col("context").alias("code"), "question", X.options_text(F.col("options")).alias("options_text"), F.col("answer").alias("correct_letter"), F.coalesce("is_hard", F.lit(False)).alias("is_hard"))


def clone_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Pair files by number with their two blocks; files that do not split are dropped before the limit."""
    rows = code_files(spark, path).select(X.base_name(F.col("path")).alias("file"), X.split_pair(F.col("code")).alias("p")).where("p IS NOT NULL")
    rows = rows.select("file", "p.left", "p.right", X.file_order(F.col("file")).alias("order_key"))
    return rows if limit is None else rows.orderBy(F.asc_nulls_last("order_key"), "file").limit(limit)


def completion_rows(rows: DataFrame, language: str = "python", wanted: int | None = None, most_lines: int = 50, least_tokens: int = 3000) -> DataFrame:
    """rows(id, context, gt, pos) with background and current function; filtered, with the small-set fallback."""
    if wanted is not None:
        rows = relational.first_rows(rows, "pos", max(10 * wanted, 50))
    code = F.col("context")
    if language == "python":
        background, current = X.split_last_definition(code)
    else:
        chunk = F.element_at(retrieval.function_chunks(code, F.lit(language)), -1)
        background, current = X.split_last_chunk(code, F.coalesce(chunk, F.lit("")))
    made = rows.withColumns({"background": background, "current": current})
    kept = relational.long_background(made, most_lines, least_tokens, fallback=wanted)
    return kept if wanted is None else relational.first_rows(kept, "pos", wanted)


def results_by_mode(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of all files below a directory; the mode is in the file's name (example_<n>_<mode>.jsonl)."""
    rows = spark.read.schema(schemas.COMPLETION_RESULT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED").json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.withColumn("mode", F.coalesce("mode", F.nullif(F.regexp_extract(name, r"example_\d+_(.+)\.jsonl$", 1), F.lit(""))))


def clone_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved clone results for evaluation alone: a JSON object of mode to a list of {pred, label}."""
    kind = "map<string,array<struct<pred:boolean,label:boolean>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("mode", "rows"))
    return whole.select("mode", F.explode("rows").alias("r")).select("mode", "r.pred", "r.label")


def legacy_mode(name):
    """Mode bucket of an older file name."""
    return F.when(F.contains(name, F.lit("text_only")), "text_only").when(F.contains(name, F.lit("original")), "image").when(F.contains(name, F.lit("ratio")), "image_ratio").otherwise("unknown")


def summaries(spark: SparkSession, path: str, most_tokens: int | None = None) -> DataFrame:
    """Summarisation rows of a Parquet table within a context budget."""
    rows = spark.read.parquet(path)
    return rows if most_tokens is None else relational.within_tokens(rows, "relevant_code_context", most_tokens)


def with_cache(items: DataFrame, cache: DataFrame, key: str = "id", outputs=("output", "clean_output")) -> DataFrame:
    """Items with cached outputs; ``fetch`` says which must be asked for (missing or empty)."""
    both = items.join(cache.select(key, *outputs), key, "left")
    full = F.lit(True)
    for c in outputs:
        full = full & (F.coalesce(c, F.lit("")) != "")
    return both.withColumn("fetch", ~full)


def settings(path: str | None = None, env: dict | None = None) -> dict:
    """Settings of a JSON file, overridden by the environment; empty without a file."""
    env = dict(os.environ) if env is None else env
    got = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    return got | {k: env[k] for k in got if k in env}


def env_flag(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "y", "on")


def key_from_env_file(text: str, name: str) -> str | None:
    """Value of NAME=value in the text of an env file; comments, export and quotes are understood."""
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and key.strip() == name and not line.lstrip().startswith("#"):
            return value.strip().strip("\"'") or None
    return None
