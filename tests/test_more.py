import json

from pyspark.sql import functions as F

from quillspark.functions import layout, metrics, rendering
from quillspark.functions import text as X
from quillspark.operators import relational, reports, retrieval
from quillspark.sources import readers, writers


def test_saved_clone_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"text_only": [{"pred": True, "label": True}, {"pred": None, "label": False}], "image": []}, indent=1))
    assert [tuple(r) for r in readers.clone_results(spark, str(tmp_path / "r.json")).collect()] == [("text_only", True, True), ("text_only", None, False)]


def test_modes(spark):
    d = spark.createDataFrame([("image_ratio1.5",), ("text_only",), ("image_ratio2",)], "mode string")
    assert [r.mode for r in reports.ordered_modes(d).collect()] == ["image_ratio1", "image_ratio1.5", "image_ratio2", "image_ratio4", "image_ratio8"]
    assert [r.ratio for r in reports.ratio_rows(d).collect()] == [1.5, None, 2.0]
    assert d.limit(1).select(reports.with_base_ratio(F.array(F.lit(4.0), F.lit(2.0)))).first()[0] == [1.0, 2.0, 4.0]


def test_geometry(spark):
    pairs = spark.createDataFrame([("f", "ab\n  cd", "x" * 30)], "file string, left string, right string")
    rows = rendering.pair_rows(pairs, F.lit(224), F.lit(10))
    assert {(r.side, r.x) for r in rows.collect()} == {("left", 1), ("right", 118)}
    box = {r.file + str(r.page): r for r in rendering.content_box(rows.where("side = 'left'"), ["file"], F.lit(10)).collect()}["f1"]
    assert (box.left, box.top, box.right, box.bottom) == (1.0, 1, 25.0, 21)


def test_small_functions(spark):
    one = spark.range(1)
    cut, n = X.trim_to_tokens(F.lit("abcdefghij"), 2)
    assert tuple(one.select(cut, n).first()) == ("abcdefgh", 2)
    assert one.select(metrics.code_bleu(F.lit("a"), F.lit("b"))).first()[0] == -1.0
    assert one.select(layout.estimated_or_measured(F.lit(None).cast("int"), F.lit(7))).first()[0] == 7
    assert one.select(metrics.text_preference(F.lit("B"), F.lit("B"))).first()[0] == 0.5


def test_merging_and_caches(spark):
    rows = spark.createDataFrame([(12, "image", None), (12, "text_only", 2.0)], "font_size int, mode string, score double")
    extra = spark.createDataFrame([(12, "image", 1.0), (12, "text_only", 9.0), (14, "image", 3.0)], "font_size int, mode string, score double")
    got = {(r.font_size, r.mode): r.score for r in relational.fill_missing_modes(rows, extra).collect()}
    assert got == {(12, "image"): 1.0, (12, "text_only"): 2.0, (14, "image"): 3.0}
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    cache = spark.createDataFrame([("a", "x", "y"), ("b", "x", "")], "id string, output string, clean_output string")
    assert {r.id: r.fetch for r in readers.with_cache(items, cache).collect()} == {"a": False, "b": True, "c": True}


def test_image_sets(spark):
    names = [("i", "page_001_448x448_fs12.png"), ("i", "page_002_448x448_fs12.png"), ("j", "page_001_448x448_fs12.png"), ("j", "page_001_224x224_fs12.png")]
    got = relational.usable_image_sets(spark.createDataFrame(names, "item string, name string")).collect()
    assert [(r["item"], r.resolution, r.font, r.num_pages) for r in got] == [("i", 448, 12, 2)]


def test_ranked_chunks(spark):
    d = spark.createDataFrame([("q", i, i * 4, f"c{i}", [float(i == 2), float(i != 2)], [1.0, 0.1]) for i in range(4)], "id string, idx int, start int, text string, vec array<double>, query_vec array<double>")
    top = retrieval.rank_chunks(d, 2)
    assert [r.idx for r in top.orderBy("rank").collect()] == [2, 0]
    assert retrieval.context_in_source_order(top).first().context == "c0\n\nc2"
    assert retrieval.context_by_similarity(top).first().context == "c2\n\nc0"


def test_redaction_and_names(spark):
    m = "array<struct<type:string,text:string,image_url:string>>"
    d = spark.createDataFrame([([("text", "a", None), ("image_url", None, "data:image/png;base64,AAAA")],)], f"m {m}")
    assert [r.image_url for r in d.select(X.redact_images(F.col("m"))).first()[0]] == [None, "<image omitted>"]
    assert d.select(writers.folder_name(F.lit("out"), F.lit("a"), F.lit("b"), highlight=True, bold=True)).first()[0] == "out/a_b_hl_bold"
