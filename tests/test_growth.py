"""Steps whose memory or work must not grow faster than their input."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import layout as L
from quillspark.functions import metrics as M
from quillspark.functions import rendering as R
from quillspark.operators import retrieval


def unit(a):
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def brute_top_k(rows, queries, k):
    found = []
    for q, x in queries:
        got = sorted((-round(float(np.dot(unit(np.array([x]))[0], unit(np.array([y]))[0])), 9) + 0.0, i) for i, y in rows if i != q)
        found += [(q, i, -s + 0.0, rank + 1) for rank, (s, i) in enumerate(got[:k])]
    return sorted(found)


def test_top_k_tiles(spark):
    """Ties, equal and zero vectors; the plan reads the rows as often, whatever the number of queries."""
    rng = random.Random(11)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in rng.sample(range(10**6), 120)]
    rows += [(10**6 + i, [1.0, 2.0, 3.0]) for i in range(20)] + [(2 * 10**6, [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = d.where("id % 3 = 0 OR id >= 1000000")
    queries = [r for r in rows if r[0] % 3 == 0 or r[0] >= 10**6]
    for block in (2, 50, 4096):
        got = retrieval.top_k(d, asked, 4, block=block)
        assert sorted(tuple(r) for r in got.collect()) == brute_top_k(rows, queries, 4)
        assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_top_k_memory_is_bounded():
    made = np.random.default_rng(3)
    q, v = unit(made.normal(size=(2000, 8))), unit(made.normal(size=(20000, 8)))
    tracemalloc.start()
    at, to, value = retrieval.nearest(np.arange(2000), q, np.arange(20000), v, 3, slab=1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 6000 and peak < 16 << 20  # all similarities are 320 MB
    for i in (0, 777, 1999):
        sims = np.round(v @ q[i], 9)
        sims[i] = -np.inf
        assert to[at == i].tolist() == np.lexsort((np.arange(20000), -sims))[:3].tolist()


def test_omissions_need_no_band(monkeypatch):
    """Text with omissions only takes one pass, either way round; other pairs still meet the bands."""
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefgh .,") for _ in range(60_000))
    less = text.replace("ab", "a").replace(",", "")
    with monkeypatch.context() as m:
        m.setattr(M, "_letter_bits", None)
        assert M.bit_distance(text, less) == M.bit_distance(less, text) == len(text) - len(less)
        assert M.bit_distance(text, text) == 0 and M.bit_distance("", text) == len(text)
    assert M.bit_distance(text, text[:100] + "#" + text[101:30_000] + "##" + text[30_002:]) == 3


def test_text_measures_hold_one_pair():
    """A batch of 80 MB of text is measured without a copy of it in Python."""
    a = pa.array(["some words of one line\nand of another " * 1000] * 1000)
    for measure in (M._long_distance, M.word_distance, M.line_similarity):
        tracemalloc.start()
        got = measure.func(a, a)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == 1000 and len(set(got.to_pylist() if isinstance(got, pa.Array) else got)) == 1
        assert peak < 8 << 20


def test_token_array(monkeypatch):
    """Arrow's tokens are those of the lexer, row by row, and few of a batch's tokens are Python objects at a time."""
    from pygments import lex
    from pygments.lexers import get_lexer_by_name, guess_lexer

    code = ["def f(x):\n    # note\n    return 'a'", None, "", "int main() { return 0; }", "x = 1", "#!/usr/bin/python\nimport os", None, "class C: pass"]
    names = ["python", "python", "python", "cpp", "nosuch", None, None, "python"]
    lexer = lambda c, n: get_lexer_by_name({"nosuch": "python"}.get(n, n)) if n else guess_lexer(c)
    for piece in (2, 1 << 15):
        monkeypatch.setattr(R, "PIECE", piece)
        for theme, color in ((R.MODERN, R.color_of), (R.LIGHT_B, R.color_below)):
            want = [None if c is None else [{"text": t, "color": color(str(kind), theme)} for kind, t in lex(c, lexer(c, n))] for c, n in zip(code, names, strict=True)]
            assert R.token_array(pa.array(code, pa.string()), pa.array(names), theme, color).to_pylist() == want
    batch = pa.array(["x = 1\n" * 500] * 100)
    tracemalloc.start()
    got = R.syntax_tokens("modern").func(batch, pa.array(["python"] * 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 100 and sum(map(len, got)) >= 300_000 and peak < 16 << 20


def test_max_font_reads_the_lines_once_a_step(spark):
    rng = random.Random(13)
    rows = [([rng.choice((0, 1, 9, 40, 200)) for _ in range(rng.randint(1, 40))], rng.choice((14, 112, 448, 896)), rng.randint(1, 6)) for _ in range(40)] + [(None, 112, 1)]
    d = spark.createDataFrame(rows, "sizes array<int>, res int, pages int")
    font = L.max_font(F.col("sizes"), F.col("res"), F.col("pages"))
    plan = d.select(font.alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2  # the steps and, in each, the lines

    def needed(sizes, res, font):
        area = res - 2 * int(res * 0.01)
        c, m = max(1, int(area / (font * 0.6))), max(1, int(area / font))
        return 1 + (sum(max(0, -(-n // c) - 1) for n in sizes) + len(sizes) - 1) // m

    for r in d.withColumn("f", font).collect():
        low, high, best = 4, 150, 4
        while r.sizes is not None and low <= high:
            mid = (low + high) // 2
            if needed(r.sizes, r.res, mid) <= r.pages:
                low, best = mid + 1, mid
            else:
                high = mid - 1
        assert r.f == best
