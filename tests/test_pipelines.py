from functools import partial

import pytest
from pyspark.sql import functions as F

from quillspark.functions import layout as L
from quillspark.functions import rendering
from quillspark.operators import layout_search, reports
from quillspark.plans import pipelines
from quillspark.streaming import clients


def says(text):
    return partial(clients.FixedClient, text)


def test_completion(spark):
    rows = spark.createDataFrame([("a", "def f():\n  return 1\n\ndef g():\n  return 2\n", "def h():", "  return 3"), ("b", "", "x", "y")], "id string, background string, current string, gt string")
    got = pipelines.completion(rows, says("```python\n  return 3\n```"), (1.0,)).collect()
    assert {(r.id, r.mode, r.es, r.em) for r in got} == {("a", "text_only", 100.0, 100.0), ("a", "image_ratio1", 100.0, 100.0)}
    assert reports.mode_average(pipelines.completion(rows, says("no"), (1.0,), keep_without_context=True)).count() == 2


def test_retrieval_prefers_similar_chunks(spark):
    rows = spark.createDataFrame([("a", "def f():\n  alpha beta\n\ndef g():\n  gamma delta\n", "gamma delta")], "id string, background string, current string")
    assert "gamma" in pipelines.retrieved(rows.withColumn("gt", F.lit("")), 1).first().context


def test_clones(spark):
    pairs = spark.createDataFrame([("p", "a", "b", True), ("q", "c", "d", False)], "file string, left string, right string, label boolean")
    got = pipelines.clones(pairs, says('{"is_same": true}'), (1.0,))
    c = {r["mode"]: r for r in reports.confusion(got).collect()}
    assert c["text_only"].tp == 1 and c["image_ratio1"].fp == 1
    assert {r.pred for r in pipelines.clones(pairs, says("who knows"), (1.0,)).collect()} == {None}


def test_summaries(spark):
    rows = spark.createDataFrame([("i", "d", "code", "gold"), ("j", "e", "code", "")], "intent string, docfile_name string, relevant_code_context string, target_text string")
    got = {r.intent: r.score for r in pipelines.summaries(rows, says("ours"), says("B")).collect()}
    assert got == {"i": 0.5, "j": None}


def test_reconstruction(spark):
    truth = spark.createDataFrame([("a", "f(x):\n  return (1, 2)"), ("b", "")], "code_id string, code string")
    got = {(r.code_id, r.ratio): r for r in pipelines.reconstruction(truth, says("f x\n  return 1 2"), (1.0, 2.0)).collect()}
    assert len(got) == 4 and got["a", 1.0].taxonomy["Symbol_Loss"] and got["b", 1.0].cer == 1.0
    done = spark.createDataFrame([("a", 1.0)], "code_id string, ratio double")
    left = pipelines.reconstruction(truth, says("x"), (1.0, 2.0), done)
    assert left.count() == 3
    verdicts = spark.createDataFrame([("a", 2.0, {"Visual_Typo": True, "Other": True})], "code_id string, ratio double, judge map<string,boolean>")
    merged = {(r.code_id, r.ratio): r.taxonomy for r in pipelines.judged(left, verdicts).collect()}
    assert merged["a", 2.0]["Visual_Typo"] and "Other" not in merged["a", 2.0]


def test_selection(spark):
    assert pipelines.selected(" a ,b", ("a", "b")) == ["a", "b"]
    with pytest.raises(ValueError):
        pipelines.selected("c", ("a",))
    rows, cache = spark.range(5).toDF("id"), spark.range(3).toDF("id")
    again, kept = pipelines.only_rows(rows, [1, 4], cache)
    assert {r.id for r in again.collect()} == {1, 4} and {r.id for r in kept.collect()} == {0, 2}
    assert pipelines.only_rows(rows, None, cache)[0].count() == 2
    assert pipelines.page_limit("GLM-4") == 50 and pipelines.page_limit("x") == 100


def test_compressed_sizes(spark):
    d = spark.createDataFrame([(1000, float(r)) for r in (0, 1, 2, 4)], "tokens int, ratio double")
    got = {r.ratio: r.s for r in d.select("ratio", pipelines.compressed_resolution(F.col("tokens"), F.col("ratio"), F.lit(1024), F.lit(1)).alias("s")).collect()}
    assert got[0.0] == 14 and got[1.0] == 1024 and got[2.0] > got[4.0] > 112


def test_two_columns():
    import random

    def letter_by_letter(sizes, res, font):
        margin, step, wide = int(res * 0.01), font, font * 0.6
        most = int((res - 2 * margin) / step)
        pages, column, row, left, x, widest = 1, 0, 0, margin, margin, 0
        for k, n in enumerate(sizes):
            for ch in ["new"] * (k > 0) + ["x"] * n:
                bound = left + (res - 2 * margin) // 2 if column == 0 else res - margin
                if ch == "new" or (x + wide > bound + 1e-9 and x > left):
                    row += 1
                    if row >= most:
                        if column == 0 and widest <= res / 2:
                            column, left = 1, res // 2 + 5
                        else:
                            pages, column, left = pages + 1, 0, margin
                        row, widest = 0, 0
                    x = left
                if ch != "new":
                    x += wide
                    widest = max(widest, x - left)
        return pages, (most * column + row) / (2 * most)

    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice((0, 1, 5, 9, 10, 30)) for _ in range(rng.randint(1, 60))]
        res, font = rng.choice((112, 224)), rng.choice((5, 10, 20))
        got, want = L.two_column_layout(sizes, res, font), letter_by_letter(sizes, res, font)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9
    assert L.two_column_layout([5], 112, 0) == (9999, 0.0)


def test_fitted_search_is_the_largest_font_that_fits(spark):
    text = "\n".join("x" * n for n in (40, 10, 0, 60, 33) * 20)
    d = spark.createDataFrame([(1, text)], "k int, text string")
    d = d.select("k", L.text_tokens(F.col("text")).alias("tokens"), *(c.alias(n) for n, c in L.structure(F.col("text")).items()), L.line_lengths(F.col("text")).alias("sizes"))
    d = d.withColumns({"target": F.col("tokens") / 1, "ratio": F.lit(1.0), "used": F.array().cast(layout_search.USED)})
    r = layout_search.search_fitted(d).first()
    check = d.select(L.layout_pages(F.col("sizes"), F.lit(r.res), F.lit(r.font))[0].alias("a"), L.layout_pages(F.col("sizes"), F.lit(r.res), F.lit(r.font + 1))[0].alias("b")).first()
    assert check.a <= r.pages < check.b
    none = layout_search.search_fitted(d.withColumn("target", F.lit(1e-3))).first()
    assert (none.res, none.pages) == (112, 1)


def test_themes():
    assert rendering.color_of("Token.Keyword.Declaration", rendering.MODERN) == "#AF00DB"
    assert rendering.color_below("Token.Name.Function", rendering.LIGHT_B) == "#000000"
    assert rendering.color_below("Token.Name.Builtin.Pseudo", rendering.MODERN_B) == "#795E26"
    assert rendering.color_below("Token.Text", rendering.MODERN_B) == "#000000"
