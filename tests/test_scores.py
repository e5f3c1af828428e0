import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import layout as L
from quillspark.functions import metrics as M
from quillspark.functions import text as X
from quillspark.operators import layout_search, relational, reports, retrieval


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_bit_distance():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcü") for _ in range(rng.randint(0, 40))) for _ in "ab")
        assert M.bit_distance(a, b) == plain_distance(a, b)


def test_bands_agree_with_the_whole_table():
    rng = random.Random(11)
    for _ in range(60):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randint(250, 420)))
        b = list(a)
        for _ in range(rng.choice((1, 5, 40, 90))):
            at = rng.randrange(len(b))
            b[at : at + rng.choice((0, 1, 2))] = rng.choice(("", "x", "ab"))
        b = "".join(b)
        assert M.bit_distance(a, b) == plain_distance(a, b)
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        where = M._letter_bits(long)
        for most in (3, 20, 64, 100):
            got = M._banded(long, short, where, most)
            assert got is None or got == plain_distance(a, b)
            if plain_distance(a, b) <= most:
                assert got == plain_distance(a, b)


def test_long_and_short_distances_agree(spark):
    rng = random.Random(4)
    rows = []
    for n in (0, 5, 511, 513, 900):
        a = "".join(rng.choice("abcd é") for _ in range(n))
        rows.append((a, a.replace("a", "", 20) + "xyz"))
    rows.append((None, "a"))
    d = spark.createDataFrame(rows, "a string, b string").select(M.edit_distance(F.col("a"), F.col("b")).alias("x"), F.levenshtein("a", "b").alias("y"))
    assert [r.x for r in d.collect()] == [r.y for r in d.collect()]


def test_rates(spark):
    rows = [("", ""), ("", "a"), ("ab", ""), ("abcd", "abd")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(M.cer(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0, 1.0, 0.25]
    words = [(" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(0, 300, 2))), ("", "a"), ("a b", "a c")]
    d = spark.createDataFrame(words, "a string, b string").select(M.wer(F.col("a"), F.col("b")).alias("x"), M.wer(F.col("a"), F.col("b"), any_length=False).alias("y"))
    assert [tuple(r) for r in d.collect()] == [(0.5, 0.5), (1.0, 1.0), (0.5, 0.5)]


def test_line_similarity(spark):
    a, b = "a\nb\nc\nd", "a\nx\nc\nd"
    got = spark.createDataFrame([(a, b), ("", "")], "a string, b string").select(M.line_similarity("a", "b")).collect()
    assert got[0][0] == pytest.approx(difflib.SequenceMatcher(None, a.split("\n"), b.split("\n")).ratio()) and got[1][0] == 1.0


def test_similarity_and_match(spark):
    rows = [("", "", 100.0, 100.0), ("a", "", 0.0, 0.0), (" a \n\nb", "# c\na\nb\nc", 100.0, 100.0), ("ab", "ac", 50.0, 0.0)]
    d = spark.createDataFrame(rows, "t string, p string, es double, em double")
    for r in d.select(M.edit_similarity(F.col("t"), F.col("p")).alias("a"), M.exact_match(F.col("t"), F.col("p")).alias("b"), "es", "em").collect():
        assert (r.a, r.b) == (r.es, r.em)


def windows_by_loop(lines, size, overlap):
    out, start, step = [], 0, size - overlap
    while start < len(lines):
        out.append("\n".join(lines[start : start + size]))
        if start + size >= len(lines):
            break
        start += step
    return list(dict.fromkeys(out))


def test_sliding_chunks(spark):
    rng = random.Random(5)
    for n, size, overlap in ((0, 4, 2), (1, 4, 2), (4, 4, 2), (9, 4, 1), (10, 4, 3), (23, 5, 0)):
        code = "\n".join(rng.choice("ab") for _ in range(n))
        got = spark.createDataFrame([(code,)], "c string").select(retrieval.sliding_chunks(F.col("c"), size, overlap)).first()[0] or []
        assert got == windows_by_loop(code.splitlines(), size, overlap)
    with pytest.raises(ValueError):
        retrieval.sliding_chunks(F.col("c"), 4, 4)


@pytest.mark.parametrize("language, code, n", [
    ("python", "import a\ndef f():\n  pass\nclass C:\n  pass", 3), ("go", "package a\nfunc f() int { return 1 }\nfunc g() { }\n", 3), ("rust", "use a;\nfn f() { }\npub fn g() { }", 3), ("python", "x = 1", 1), ("python", "", 0), ("cobol", "def f():\n pass", 1),
])
def test_split_functions(language, code, n):
    chunks = retrieval.split_functions(code, language)
    assert len(chunks) == n
    assert "".join("".join(chunks).split()) == "".join(code.split())


def test_split_python():
    code = "import a\n\n@d\ndef f():\n  def g(): pass\n\nasync def h(): pass\nclass C:\n  x = 1\n"
    chunks = retrieval.split_python(code)
    assert len(chunks) == 4 and "".join(chunks) == code and chunks[1].startswith("@d")
    assert retrieval.split_python("def broken(:\n") == ["def broken(:"]


def simulate(text, res, font):
    margin = int(res * 0.01)
    area = res - 2 * margin
    c, m = max(1, int(area / (font * 0.6))), max(1, int(area / max(1, int(font))))
    pages, row, col = 1, 0, 0
    for ch in text:
        if ch == "\n" or col == c:
            row += 1
            col = 0
            if row >= m:
                pages, row = pages + 1, 0
        if ch != "\n":
            col += 1
    return pages, row


def test_layout_closed_form(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        text = "\n".join("x" * rng.choice((0, 1, 7, 30, 90)) for _ in range(rng.randint(1, 60)))
        res, font = rng.choice((112, 224, 448)), rng.choice((4, 9, 20, 60, 150))
        rows.append((text, res, font, *simulate(text, res, font)))
    d = spark.createDataFrame(rows, "t string, res int, font int, pages int, lines int")
    pages, lines = L.layout_pages(L.line_lengths(F.col("t")), F.col("res"), F.col("font"))
    for r in d.select(pages.alias("p"), lines.alias("l"), "pages", "lines").collect():
        assert (r.p, r.l) == (r.pages, r.lines)
    best = d.select("t", "res", L.max_font(L.line_lengths(F.col("t")), F.col("res"), F.lit(2)).alias("f")).collect()
    for r in best[:15]:
        assert r.f == max([f for f in range(4, 151) if simulate(r.t, r.res, f)[0] <= 2], default=4)


def test_searches_fall_back(spark):
    t = spark.createDataFrame([(1, 0.001, 1, 1.0, [])], f"k int, target double, tokens int, ratio double, used {layout_search.USED}")
    assert tuple(layout_search.search_a(t).first())[1:] == (112, 4, 1)
    assert tuple(layout_search.search_b(t).first())[1:] == (112, 3, 1)


def test_used_sizes_change_the_plan(spark):
    plans = layout_search.plan_ratios(spark.createDataFrame([(600,), (600,), (40,)], "tokens int"), (0, 1, 2, 4)).collect()
    assert len(plans) == 8 and {(r.res, r.font) for r in plans if r.ratio == 0} == {(14, 0)}


def test_confusion_counts_unparsed_as_wrong(spark):
    rows = [("m", True, True), ("m", None, True), ("m", False, False), ("m", True, False), ("n", None, True)]
    got = {r["mode"]: r for r in reports.confusion(spark.createDataFrame(rows, "mode string, pred boolean, label boolean")).collect()}
    assert (got["m"].acc, got["m"].precision, got["m"].recall, got["m"].valid_total) == (0.5, 0.5, 1.0, 3)
    assert (got["n"].acc, got["n"].f1) == (0.0, 0.0)


def test_pending_and_errors(spark):
    cases = relational.expand_ratios(spark.createDataFrame([("a",), ("b",)], "code_id string"), (1, 1.5))
    done = spark.createDataFrame([("a", 1.0, None), ("b", 1.5, "failed")], "code_id string, ratio double, error string")
    assert relational.pending(cases, done).count() == 2
    assert relational.pending(cases, done, retry_errors=True).count() == 3


def test_positions(spark):
    ids = random.Random(7).sample(range(10**6), 500)
    got = relational.positions(spark.createDataFrame([(i,) for i in ids], "i long"), "i").orderBy("i").collect()
    assert [r.pos for r in got] == list(range(500)) and [r.i for r in got] == sorted(ids)


def test_top_k_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    d = spark.createDataFrame(rows, "id long, vec array<double>")
    a = sorted(map(tuple, retrieval.top_k(d, d.where("id % 20 = 0"), 3).collect()))
    b = sorted(map(tuple, retrieval.top_k(d, d.where("id % 20 = 0"), 3, block=2).collect()))
    assert a == b and len(a) == 15


def test_mode_labels(spark):
    got = [r[0] for r in spark.createDataFrame([("image_ratio2",), ("image_ratio1.5",), ("image_ratio4.0",), ("image",)], "m string").select(reports.mode_label(F.col("m"))).collect()]
    assert got == ["Compress 2x", "Compress 1.5x", "Compress 4x", "image"]


def test_whole_documents_against_brute_force(spark):
    a = "the cat\n\nsat on  \nthe mat " * 40
    d = spark.createDataFrame([(a, a.replace("cat", "cut"))], "a string, b string")
    r = d.select(M.cer(X.without_blank_lines(F.col("a")), X.without_blank_lines(F.col("b"))).alias("c")).first()
    clean = lambda s: "\n".join(x.rstrip() for x in s.splitlines() if x.strip())
    assert r.c == pytest.approx(plain_distance(clean(a), clean(a.replace("cat", "cut"))) / len(clean(a)))
