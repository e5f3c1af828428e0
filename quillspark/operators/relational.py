"""Relational steps of the evaluation pipelines: expansion, pending work, grouping, pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X


def expand_ratios(items: DataFrame, ratios) -> DataFrame:
    """Every item with every ratio: an explode of a literal array, so nothing is shuffled or broadcast."""
    return items.withColumn("ratio", F.explode(F.array(*(F.lit(float(r)) for r in ratios))))


def pending(cases: DataFrame, done: DataFrame, keys=("code_id", "ratio"), retry_errors: bool = False) -> DataFrame:
    """Cases that are not done; a record with an error counts as done unless retried."""
    if retry_errors and "error" in done.columns:
        done = done.where(F.col("error").isNull())
    return cases.join(done.select(*keys), list(keys), "left_anti")  # repeated keys on the right do no harm


def done_keys(records: DataFrame) -> DataFrame:
    """Resume keys of stored records: the image path, and ``id|ratio``."""
    pair = F.when(F.col("code_id").isNotNull() & F.col("ratio").isNotNull(), F.concat_ws("|", "code_id", F.format_string("%s", F.col("ratio"))))
    return records.select(F.explode(F.array_compact(F.array("image_path", pair))).alias("done_key")).distinct()


def score_inputs(results: DataFrame, truth: DataFrame, key: str = "code_id") -> DataFrame:
    """Results with their ground truth; results without one drop out. The later of equal ids wins in truth.

    Spark broadcasts the truth where its measured size allows and shuffles otherwise."""
    return results.join(truth, key, "inner")


def last_by_position(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key, that of the highest position."""
    best = F.max_by(F.struct(*rows.columns), F.col(position))
    return rows.groupBy(key).agg(best.alias("_r")).select("_r.*")


def page_groups(paths: DataFrame) -> DataFrame:
    """Image paths to (code_id, ratio) with pages ordered by page number and name."""
    path = F.col("path")
    pages = paths.select(X.case_of(path).alias("code_id"), X.ratio_of(path).alias("ratio"), F.struct(X.page_of(path).alias("page"), X.base_name(path).alias("name"), path.alias("path")).alias("p"))
    return pages.groupBy("code_id", "ratio").agg(F.array_sort(F.collect_list("p")).alias("pages")).select("code_id", "ratio", F.size("pages").alias("num_pages"), F.transform("pages", lambda p: p["path"]).alias("image_paths"))


def positions(rows: DataFrame, order: str, name: str = "pos", buckets: int = 4096) -> DataFrame:
    """rows with 0-based positions by a unique integer column, without one task that holds them all.

    Rows are ranked within ranges of the column; the ranges' sizes, a few thousand numbers, are accumulated."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    keyed = rows.withColumn("_b", F.floor((F.col(order) - F.lit(low or 0)) / width))
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return keyed.join(F.broadcast(starts), "_b").withColumn(name, F.col("_start") + rank - 1).drop("_b", "_start")  # at most 4097 ranges


def balanced_pairs(pairs: DataFrame, total: int | None = None) -> DataFrame:
    """pairs(pos, file, left, right) to positives and as many negatives, labelled, in a fixed mixed order.

    Row i's left meets the right of row n-1-i; where that is the same file, of the reversed row i+1."""
    n = pairs.count()
    half = n if total is None else total // 2
    yes = pairs.where(F.col("pos") < half).select("file", "left", "right", F.lit(True).alias("label"))
    other = F.lit(n - 1) - F.col("pos")
    at = F.when(other == F.col("pos"), F.lit(n - 1) - F.pmod(F.col("pos") + 1, F.lit(max(n, 1)))).otherwise(other)
    right = pairs.select(F.col("pos").alias("_at"), F.col("file").alias("_file"), F.col("right").alias("_right"))
    no = pairs.where(F.col("pos") < half).withColumn("_at", at).join(right, "_at")
    no = no.select(F.concat("file", F.lit("___vs___"), "_file").alias("file"), "left", F.col("_right").alias("right"), F.lit(False).alias("label"))
    return yes.unionByName(no).withColumn("order_key", F.md5(F.concat_ws("|", "file", F.col("label").cast("string"))))


def zip_pages(left: DataFrame, right: DataFrame, key: str = "page") -> DataFrame:
    """Pages of two sides by number; the missing side is null."""
    return left.join(right, key, "full_outer")


def fill_missing_modes(rows: DataFrame, extra: DataFrame, keys=("font_size", "mode"), values=("score",)) -> DataFrame:
    """Values of extra where rows have none for the key, and keys that only extra has."""
    add = extra.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    return rows.join(add, list(keys), "full_outer").select(*keys, *(F.coalesce(v, f"_{v}").alias(v) for v in values))


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by position: a limit is the feature here."""
    return rows.orderBy(F.asc_nulls_last(order)).limit(n)


def usable_image_sets(images: DataFrame, name: str = "name") -> DataFrame:
    """Files named ``page_<n>_<res>x<res>_fs<font>.png`` by item; only items with exactly one setting."""
    made = images.select("item", F.regexp_extract(name, r"_(\d+)x\d+", 1).cast("int").alias("resolution"), F.regexp_extract(name, r"_fs(\d+)", 1).cast("int").alias("font"), F.regexp_extract(name, r"page_(\d+)", 1).cast("int").alias("page"))
    grouped = made.groupBy("item").agg(F.countDistinct("resolution", "font").alias("settings"), F.max("resolution").alias("resolution"), F.max("font").alias("font"), F.count(F.lit(1)).alias("num_pages"))
    return grouped.where("settings = 1").drop("settings")


def long_background(rows: DataFrame, most_lines: int = 50, least_tokens: int = 3000, fallback: int | None = None) -> DataFrame:
    """Completion rows with a short current function and a long background.

    If fewer than ``fallback`` rows pass, all rows are returned, as with small data sets."""
    tokens = F.when(X.is_blank(F.col("background")), 0).otherwise(F.greatest(F.lit(1), F.floor(F.length("background") / 4)))
    kept = rows.where((F.size(X.split_lines(F.col("current"))) <= most_lines) & (tokens >= least_tokens))
    if fallback is not None and kept.limit(fallback).count() < fallback:
        return rows
    return kept


def within_tokens(rows: DataFrame, column: str, most: int) -> DataFrame:
    """Rows whose text is within a token budget; null counts as no tokens."""
    return rows.where(F.when(F.col(column).isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(column) / 4))) <= most)
