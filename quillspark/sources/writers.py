"""Writers of results and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X


def append_records(rows: DataFrame, path: str) -> None:
    """One JSON line for each finished case, added to what is there."""
    rows.write.mode("append").json(path)


def write_by_mode(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("mode").json(path)


def report_json(rows: DataFrame, name: str = "results") -> DataFrame:
    """All rows of a report, which is small by nature, as one JSON object of sorted rows."""
    return rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))).alias("json"))


def record_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def show_report(rows: DataFrame, by: str = "mode", n: int = 100) -> None:
    rows.orderBy(by).show(n, truncate=False)


def dataset_name(model: Column) -> Column:
    return F.concat(F.lit("dataset_"), X.safe_filename(model), F.lit(".json"))


def folder_name(base: Column, *parts: Column, highlight: bool = False, newlines: bool = False, bold: bool = False) -> Column:
    """Folder of a run: parts and the flags that are on, joined by underscores."""
    flags = [F.lit(f) for f, on in (("hl", highlight), ("nl", newlines), ("bold", bold)) if on]
    return F.concat_ws("/", base, F.concat_ws("_", *parts, *flags))


def page_name(page: Column, ratio: Column | None = None) -> Column:
    name = F.format_string("page_%03d", page)
    if ratio is not None:
        shown = F.regexp_replace(ratio.cast("string"), r"\.0$", "")
        name = F.concat(name, F.lit("_ratio"), shown)
    return F.concat(name, F.lit(".png"))
