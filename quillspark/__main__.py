"""python -m quillspark plan|score|run: a file's layout at a ratio, two files compared, a query of the catalogue."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.functions import layout, metrics
from quillspark.functions import text as X
from quillspark.operators import layout_search
from quillspark.sources import readers, writers

SAMPLE = "def area(width, height):\n    return width * height\n"


def plan(spark, path: str | None, code: str | None, ratio: float):
    """One record: language, tokens, line structure, and the layout that costs tokens / ratio."""
    rows = readers.code_or_sample(spark, code, path, SAMPLE)
    rows = rows.select(F.lit(1).alias("k"), X.language_of(F.lit(path or "")).alias("language"), layout.text_tokens(F.col("code")).alias("tokens"), *(c.alias(n) for n, c in layout.structure(F.col("code")).items()), layout.line_lengths(F.col("code")).alias("sizes"))
    rows = rows.withColumns({"target": F.col("tokens") / ratio, "ratio": F.lit(float(ratio)), "used": F.array().cast(layout_search.USED)})
    found = layout_search.search_fitted(rows)
    cost = F.col("pages") * layout.image_tokens_b(F.col("res"), F.col("res"))
    return rows.join(found, "k").select("language", "tokens", "num_lines", "max_line_chars", "ratio", "res", "font", "pages", cost.alias("cost"))


def score(spark, ref: str, hyp: str):
    """One record: character and word rates of the normalised texts, and whether they are equal."""
    whole = lambda path, name: spark.read.text(path, wholetext=True).select(F.lit(1).alias("k"), F.col("value").alias(name))
    both = whole(ref, "r").join(whole(hyp, "h"), "k").select(X.normalize_demo(F.col("r")).alias("r"), X.normalize_demo(F.col("h")).alias("h"))
    return both.select(metrics.cer(F.col("r"), F.col("h")).alias("cer"), metrics.demo_wer(F.col("r"), F.col("h")).alias("wer"), (F.col("r") == F.col("h")).alias("exact"))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillspark")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("plan")
    one.add_argument("path", nargs="?")
    one.add_argument("--code")
    one.add_argument("--ratio", type=float, default=1.0)
    two = commands.add_parser("score")
    two.add_argument("reference")
    two.add_argument("hypothesis")
    run = commands.add_parser("run")
    run.add_argument("query")
    run.add_argument("tables")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if given.command == "run":
        from quillspark.plans import catalog

        catalog.QUERIES[given.query](spark, given.tables).show(truncate=False)
        return
    rows = plan(spark, given.path, given.code, given.ratio) if given.command == "plan" else score(spark, given.reference, given.hypothesis)
    print(writers.record_json(rows).first()[0])


if __name__ == "__main__":
    main()
