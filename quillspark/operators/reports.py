"""Aggregates and reports over evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.schemas import MODES


def error_report(scored: DataFrame, by: str = "ratio") -> DataFrame:
    """Per ratio: n, mean cer, wer and line similarity (those there are), share without error."""
    means = [F.avg(c).alias(c) for c in ("cer", "wer", "line_sim") if c in scored.columns]
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *means, (F.avg((F.col("cer") == 0).cast("int")) * 100).alias("perfect_pct"))


def with_total(report: DataFrame, scored: DataFrame, by: str = "ratio", name: str = "ALL") -> DataFrame:
    """The report and a row over everything."""
    total = error_report(scored.withColumn("_all", F.lit(name)), "_all").withColumnRenamed("_all", by)
    return report.withColumn(by, F.col(by).cast("string")).unionByName(total)


def merge_flags(heuristic: Column, judge: Column) -> Column:
    """Flags of two map<string,boolean>: true where either is; names that the first lacks are ignored."""
    return F.transform_values(heuristic, lambda k, v: v | F.coalesce(judge[k], F.lit(False)))


def accuracy(results: DataFrame, by=("mode",)) -> DataFrame:
    return results.groupBy(*by).agg(F.avg(F.col("is_correct").cast("int")).alias("accuracy"), F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total"))


def accuracy_nested(results: DataFrame) -> DataFrame:
    """Accuracy by mode, and within it by source file (source_file null: the mode's own row)."""
    return results.groupingSets([["mode"], ["mode", "source_file"]], "mode", "source_file").agg(F.avg(F.col("is_correct").cast("int")).alias("accuracy"), F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("total"))


def confusion(results: DataFrame, by: str = "mode") -> DataFrame:
    """Counts, accuracy over all rows, and precision, recall and F1 over the parsed ones (0 where undefined)."""
    pred, label = F.col("pred"), F.col("label")
    counts = results.groupBy(by).agg(
        F.count_if(pred & label).alias("tp"), F.count_if(pred & ~label).alias("fp"), F.count_if(~pred & ~label).alias("tn"), F.count_if(~pred & label).alias("fn"),
        F.count(F.lit(1)).alias("total"), F.count(pred).alias("valid_total"),
    )
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counts = counts.withColumns({"acc": part(F.col("tp") + F.col("tn"), F.col("total")), "precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return counts.withColumn("f1", part(2 * p * r, p + r))


def score_stats(scores: DataFrame, by: str = "mode", value: str = "score") -> DataFrame:
    """Count, mean, population deviation, least, most and exact median.

    The median sorts within a group's value counts, so equal scores cost one entry."""
    return scores.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.median(value).alias("median"))


def with_empty_modes(stats: DataFrame, modes=MODES, by: str = "mode") -> DataFrame:
    """A zero row for each mode without results."""
    named = stats.sparkSession.createDataFrame([(m,) for m in modes], f"{by} string")
    out = named.join(stats, by, "left")
    return out.select(by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("n").isNull(), "no results").alias("note"))


def token_stats(calls: DataFrame, by: str = "mode") -> DataFrame:
    """Calls, empty completions and token sums of each mode."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(zero("completion_tokens") == 0).alias("empty_completions"), F.sum(zero("prompt_tokens")).alias("prompt_tokens"),
        F.sum(zero("completion_tokens")).alias("completion_tokens"), F.sum(zero("total_tokens")).alias("total_tokens"),
    ).withColumn("mean_tokens", F.col("total_tokens") / F.greatest("calls", F.lit(1)))


def prompt_completion_ratio(stats: DataFrame) -> DataFrame:
    """Mean over modes of prompt to completion tokens, and the ratio of the sums; modes with both above 0."""
    live = stats.where((F.col("prompt_tokens") > 0) & (F.col("completion_tokens") > 0))
    return live.agg(F.avg(F.col("prompt_tokens") / F.col("completion_tokens")).alias("mean_ratio"), (F.sum("prompt_tokens") / F.sum("completion_tokens")).alias("total_ratio"), F.count(F.lit(1)).alias("modes"))


def model_summary(stats: DataFrame) -> DataFrame:
    """Mode to its models with a mean and a count, those with results, by model."""
    live = stats.where("n > 0")
    return live.groupBy("mode").agg(F.array_sort(F.collect_list(F.struct("model", "mean", "n"))).alias("models"))


def mode_average(results: DataFrame) -> DataFrame:
    """Mean edit similarity and exact match of each mode; rows without both are left out."""
    return results.where(F.col("es").isNotNull() & F.col("em").isNotNull()).groupBy("mode").agg(F.avg("es").alias("average_es"), F.avg("em").alias("average_em"), F.count(F.lit(1)).alias("n"))


def pooled_average(results: DataFrame) -> DataFrame:
    """As mode_average over all modes in one."""
    return results.agg(F.avg("es").alias("average_es"), F.avg("em").alias("average_em"), F.count(F.lit(1)).alias("n"))


def mode_label(mode: Column) -> Column:
    """Report heading of a mode: ``Compress 2x`` for ratios, else the name."""
    ratio = F.regexp_extract(mode, r"^image_ratio(\d+(?:\.\d+)?)$", 1)
    whole = F.regexp_replace(ratio, r"\.0+$", "")
    return F.when(ratio != "", F.concat(F.lit("Compress "), whole, F.lit("x"))).otherwise(mode)


def report_cell(task: Column, values: dict[str, Column]) -> Column:
    """A report's cell in the task's format; N/A where its values are missing."""
    two = lambda c: F.format_string("%.2f", c)
    cells = {
        "code_completion_rag": F.concat(F.lit("ES:"), two(values["es"]), F.lit(" EM:"), two(values["em"])),
        "code_qa": F.concat(F.lit("Acc:"), F.format_string("%.3f", values["accuracy"]), F.lit("("), values["correct"].cast("string"), F.lit("/"), values["total"].cast("string"), F.lit(")")),
        "code_clone_detection": F.concat(F.lit("Acc:"), two(values["acc"]), F.lit(" F1:"), two(values["f1"])),
        "code_summarization": F.format_string("%.3f", values["score"]),
    }
    present = {"code_completion_rag": values["es"].isNotNull() & values["em"].isNotNull(), "code_qa": values["accuracy"].isNotNull(), "code_clone_detection": values["acc"].isNotNull(), "code_summarization": values["score"].isNotNull()}
    out = F.lit("N/A")
    for name, cell in cells.items():
        out = F.when((task == name) & present[name], cell).otherwise(out)
    return out


def mode_report(cells: DataFrame, modes=MODES) -> DataFrame:
    """cells(task, font_size, mode, cell) with a column for each mode, N/A where there is none."""
    wide = cells.groupBy("task", "font_size").pivot("mode", list(modes)).agg(F.first("cell"))
    return wide.select("task", "font_size", *(F.coalesce(F.col(f"`{m}`"), F.lit("N/A")).alias(m) for m in modes))


def ordered_modes(results: DataFrame, ratios=(1, 2, 4, 8)) -> DataFrame:
    """Ratio modes that occur or are standard, once each, by their number."""
    standard = results.sparkSession.createDataFrame([(f"image_ratio{r:g}",) for r in ratios], "mode string")
    seen = results.where(F.col("mode").startswith("image_ratio")).select("mode").distinct()
    number = F.coalesce(F.regexp_extract("mode", r"^image_ratio(\d+(?:\.\d+)?)$", 1).try_cast("double"), F.lit(float("inf")))
    return seen.union(standard).distinct().select("mode", number.alias("ratio"), mode_label(F.col("mode")).alias("label")).orderBy("ratio", "mode")


def ratio_rows(rows: DataFrame) -> DataFrame:
    """rows(mode, ...) with the ratio that the mode's name holds, null for other modes."""
    return rows.withColumn("ratio", F.nullif(F.regexp_extract("mode", r"ratio(\d+(?:\.\d+)?)$", 1), F.lit("")).cast("double"))


def with_base_ratio(ratios: Column) -> Column:
    """Ratios with 1 added if missing, once each, ascending."""
    return F.array_sort(F.array_union(ratios, F.array(F.lit(1.0))))
