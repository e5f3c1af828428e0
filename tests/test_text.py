import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (X.normalize_code, "\n \n  a \t\n\nb  \n \n", "  a\n\nb"),
        (X.normalize_code, None, ""),
        (X.normalize_code, "", ""),
        (X.normalize_code, " \n\t", ""),
        (X.normalize_demo, "  a \r\n b\n", "a\n b"),
        (X.without_blank_lines, "a \r\n\r\n b\n", "a\n b"),
        (X.clean_ocr, "\n<|begin_of_box|> a\n<|end_of_box|>\n", " a"),
        (X.clean_ocr, None, ""),
        (X.render_text, "a\tb\n–—…", "a    b\n---..."),
        (lambda c: X.render_text(c, False), "a\nb", "a⏎b"),
        (X.strip_fence, "```py\na\nb\n```", "a\nb"),
        (X.strip_fence, "a", "a"),
        (X.extract_code, "x\n```python\na\n```\ny", "a"),
        (X.extract_code, "```\na\n```\nthen\n```\nb\n```", "b"),
        (X.extract_code, "no ``` fence", "no ``` fence"),
        (X.extract_code, "```\n\n```", "```\n\n```"),
        (X.extract_code, "<|begin_of_box|> c <|end_of_box|>", "c"),
        (X.extract_code, "  ", ""),
        (X.extract_code, None, ""),
        (X.answer_letter, '{"answer":"b"}', "B"),
        (X.answer_letter, "c", "C"),
        (X.answer_letter, "The answer is D.", "D"),
        (X.answer_letter, "(A)", "A"),
        (X.answer_letter, "nothing", None),
        (X.answer_letter, "I", None),
        (X.answer_letter, "maybe B or e", "E"),
        (X.json_text, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (X.json_text, "{bad", None),
        (lambda c: X.json_flag(c, "is_same"), '{"is_same": true}', True),
        (lambda c: X.json_flag(c, "is_same"), '{"other": 1}', False),
        (lambda c: X.json_flag(c, "is_same"), "{}", None),
        (X.safe_filename, " a/b c!.py ", "a_b_c_.py"),
        (X.safe_filename, " ", "model"),
        (X.mask_key, "sk-1234567890abcdef", "sk-123...abcdef"),
        (X.mask_key, "short", "sh...rt"),
        (X.mask_key, None, ""),
        (X.ratio_of, "d/page_001_ratio1.5.png", 1.5),
        (X.ratio_of, "d/page_001_ratio2.png", 2.0),
        (X.ratio_of, "d/page_001.png", 1.0),
        (X.ratio_of, "d/page_001_ratioX.png", 1.0),
        (X.page_of, "a/b/page_012_ratio2.png", 12),
        (X.page_of, "a/b/cover.png", 0),
        (X.case_of, "out/case7/img/p.png", "case7"),
        (X.case_of, "p.png", None),
        (X.language_of, "a/B.RS", "rust"),
        (X.language_of, "noext", "python"),
        (X.file_order, "pair_12_v3.txt", 3.0),
        (X.file_order, "none.txt", None),
        (X.flat_filename, None, "unknown"),
        (X.symbol_count, "f(a, b): [1;2]", 7),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("a\nb\n\n\nc\n", ("a\nb", "c")),
        ("\n\n\na\n\nb\n \n\t\nc\n\n\nd", ("a\nb", "c")),
        ("a\n\nb", None),
        ("a\r\n\r\n\r\nb", ("a", "b")),
        ("", None),
    ],
)
def test_split_pair(spark, value, want):
    got = one(spark, value, X.split_pair)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "code, line",
    [
        ("import a\n@x\n# note\n\n@y\ndef f():\n  pass", 2),
        ("def f(): pass\nclass C:\n  x = 1", 2),
        ("x = 1", None),
        ("@lone\nx = 1\nasync  def g(): pass", 3),
        ("", None),
    ],
)
def test_last_definition(spark, code, line):
    assert one(spark, code, lambda c: X.last_definition_line(X.split_lines(c))) == line


def test_split_lines_like_python(spark):
    for s in ("", "a", "a\n", "a\r\nb", "a\n\nb\n\n", "\n", "a\x0bb\x0cc\u2028d"):
        assert one(spark, s, X.split_lines) == s.splitlines()


def test_wrap_and_chunk_split(spark):
    assert one(spark, "abcde\n\nfg", lambda c: X.wrap_lines(c, 2)) == ["ab", "cd", "e", "", "fg"]
    before, after = X.split_last_chunk(F.col("x"), F.lit("f(x)"))
    row = spark.createDataFrame([("a f(x) b f(x) c",)], "x string").select(before.alias("b"), after.alias("a")).first()
    assert tuple(row) == ("a f(x) b ", "f(x) c")
