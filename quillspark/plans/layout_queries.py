"""Queries over token costs, page estimates and layout search, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import layout as L
from quillspark.functions import rendering
from quillspark.functions import text as X
from quillspark.operators import layout_search as S
from quillspark.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_RES = "r AS (SELECT unnest(list_concat(range(14, 99, 14), range(112, 4481, 28))) AS res)"


@query("text_structure", """
SELECT doc_id, CAST(len(l) AS BIGINT) AS num_lines, CAST(list_max(l) AS BIGINT) AS max_line_chars, round(list_sum(l)::DOUBLE / len(l), 9) AS avg_line_chars, n AS total_chars
FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS l, CAST(length(text) AS BIGINT) AS n FROM documents)""")
def text_structure(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in L.structure(F.col("text")).items()))
    return out.withColumn("avg_line_chars", F.round("avg_line_chars", 9))


@query("resolutions", f"""
WITH {_RES} SELECT res, CAST(ceil(res / 112.0e0) * ceil(res / 112.0e0) * 170 AS BIGINT) AS tokens_a, CAST(greatest(1, floor(res * res / 1024.0e0)) AS BIGINT) AS tokens_b,
  CAST(170 + least(2 * ceil(res / 14.0e0) * ceil(res / 14.0e0), 100) AS BIGINT) AS tokens_patch FROM r""")
def resolutions(spark, sf_dir):
    r = F.col("res")
    rows = spark.range(1).select(F.explode(L.resolutions()).alias("res")).withColumn("res", F.col("res").cast("long"))
    return rows.select("res", L.image_tokens_a(r, r).alias("tokens_a"), L.image_tokens_b(r, r).alias("tokens_b"), L.patch_tokens(r, r).alias("tokens_patch"))


_NEAR = f"""
WITH {_RES}, t AS (SELECT DISTINCT (greatest(1, length(text) // 4))::DOUBLE / 2 AS target FROM documents),
a AS (SELECT target, res, abs(ceil(res / 112.0e0) * ceil(res / 112.0e0) * 170 - target) AS off FROM t, r),
b AS (SELECT target, res, greatest(1, floor(res * res / 1024.0e0)) AS tokens, abs(greatest(1, floor(res * res / 1024.0e0)) - target) AS off FROM t, r),
m AS (SELECT target, min(off) AS least FROM b GROUP BY target),
c AS (SELECT b.*, least FROM b JOIN m USING (target) WHERE off <= least * 1.2e0),
p AS (SELECT target, CASE WHEN max(tokens) <= min(tokens) * 1.4e0 THEN max(res) ELSE min(res) FILTER (off = least) END AS larger FROM c GROUP BY target),
n AS (SELECT target, arg_min(res, off * 10000 + res) AS nearest FROM a GROUP BY target)
SELECT target, CAST(nearest AS INTEGER) AS nearest, CAST(larger AS INTEGER) AS larger FROM n JOIN p USING (target)"""


@query("nearest_resolution", _NEAR)
def nearest_resolution(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select((L.text_tokens(F.col("text")) / 2).alias("target")).distinct()
    return t.select("target", L.nearest_resolution(F.col("target")).cast("int").alias("nearest"), L.nearest_larger(F.col("target")).cast("int").alias("larger"))


@query("page_estimates", """
WITH d AS (SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents),
g AS (SELECT *, floor((896 - 2 * (896 * 0.01e0)) / (14 * 0.6e0)) AS c, floor((896 - 2 * (896 * 0.01e0)) / 14) AS m, tokens * 3.5e0 AS chars FROM d)
SELECT doc_id, CAST(greatest(1, ceil(chars * 1.3e0 / (c * m))) AS BIGINT) AS pages_a, CAST(greatest(1, ceil(chars * (1.3e0 + (chars / 50 * c * 0.3e0) / chars) / (c * m))) AS BIGINT) AS pages_b,
  CAST(least(150, greatest(4, floor(floor(sqrt((896 - 2 * (896 * 0.01e0)) * (896 - 2 * (896 * 0.01e0)) * 0.95e0 / (chars * 0.6e0))) * 1.1e0))) AS BIGINT) AS first_font,
  CASE WHEN chars > 0 THEN 2 * greatest(1, floor(896 * 896 / 1024.0e0)) / tokens BETWEEN 0.9e0 AND 1.1e0 END AS in_range FROM g""")
def page_estimates(spark, sf_dir):
    t, res, font = F.col("tokens"), F.lit(896), F.lit(14)
    d = table(spark, sf_dir, "documents").select("doc_id", L.text_tokens(F.col("text")).alias("tokens"))
    return d.select("doc_id", L.page_estimate_a(t, res, font).alias("pages_a"), L.page_estimate_b(t, res, font).alias("pages_b"), L.initial_font(t * L.CHARS_PER_TOKEN, res).alias("first_font"), L.tokens_in_range(F.lit(2), L.image_tokens_b(res, res), t).alias("in_range"))


@query("font_limits", """
WITH s AS (SELECT doc_id, len(l) AS n, list_max(l) AS w, list_sum(l)::DOUBLE / len(l) AS a FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS l FROM documents)),
i AS (SELECT *, 896 - 2 * (896 * 0.01e0) AS q FROM s),
f AS (SELECT *, CAST(greatest(4, least(150, floor(least(q * 2 / n, CASE WHEN w > 0 THEN q / (w * 0.6e0) ELSE 150.0e0 END)))) AS BIGINT) AS font FROM i)
SELECT doc_id, font, round(least(1.5e0, font * 1.0e0 * n / (q * 2), font * 0.6e0 * a / q), 9) AS fill, round(greatest(0, least(1.5e0, 80 / (q / (font * 0.6e0)))), 9) AS horizontal FROM f""")
def font_limits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in L.structure(F.col("text")).items()))
    d = d.withColumn("font", L.optimal_font(F.lit(896), F.lit(2), F.col("num_lines"), F.col("max_line_chars")))
    fill = L.fill_rate(F.col("font"), F.lit(896), F.lit(2), F.col("num_lines"), F.col("avg_line_chars"))
    return d.select("doc_id", "font", F.round(fill, 9).alias("fill"), F.round(L.horizontal_fill(F.lit(896), F.col("font")), 9).alias("horizontal"))


@query("layout_pages", """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, sum(greatest(0, ceil(length(line) / 61.0e0) - 1)) + count(*) - 1 AS turns FROM s GROUP BY doc_id)
SELECT doc_id, CAST(1 + floor(turns / 36.0e0) AS BIGINT) AS pages, CAST(turns % 36 AS BIGINT) AS last_lines FROM w""")
def layout_pages(spark, sf_dir):
    """Pages of 448 with font 12: 440 of area, 61 characters in a line and 36 lines."""
    pages, last = L.layout_pages(L.line_lengths(F.col("text")), F.lit(448), F.lit(12))
    return table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages"), last.alias("last_lines"))


@query("max_font", """
WITH s AS (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n FROM documents),
f AS (SELECT fs, greatest(1, floor(440 / (fs * 0.6e0))) AS c, greatest(1, floor(440.0e0 / fs)) AS m FROM range(4, 151) t(fs)),
t AS (SELECT doc_id, fs, any_value(m) AS m, sum(greatest(0, ceil(n / c) - 1)) + count(*) - 1 AS turns FROM s, f GROUP BY doc_id, fs)
SELECT doc_id, CAST(coalesce(max(fs) FILTER (1 + floor(turns / m) <= 2), 4) AS BIGINT) AS font FROM t GROUP BY doc_id""")
def max_font(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.line_lengths(F.col("text")).alias("s")).select("doc_id", L.max_font(F.col("s"), F.lit(448), F.lit(2)).alias("font"))


_TARGETS = "t AS (SELECT DISTINCT greatest(1, length(text) // 4) AS k FROM documents)"
_CANDIDATES = """
c0 AS (SELECT k, k::DOUBLE / RATIO AS target, res, PER AS per FROM t, r),
c1 AS (SELECT *, greatest(1, ceil(target * LOW / per)) AS lo, least(floor(target * HIGH / per), 100) AS hi FROM c0),
c2 AS (SELECT *, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS pages FROM c1 WHERE lo <= hi),
c3 AS (SELECT *, (res - 2 * (res * 0.01e0)) * (res - 2 * (res * 0.01e0)) * pages AS area, k * 3.5e0 AS chars FROM c2),
c4 AS (SELECT *, greatest(4, least(150, CAST(floor(sqrt(area / (chars * 0.6e0 * 1.0e0))) AS INTEGER))) AS font FROM c3),
c5 AS (SELECT *, chars * ((font * 0.6e0) * (font * 1.0e0)) / area AS fill, abs(pages * per / target - 1.0e0) AS off, 1.0e0 + (res - 112) / 4368.0e0 AS bonus FROM c4)
"""
_A = _CANDIDATES.replace("RATIO", "2.0e0").replace("PER", "ceil(res / 112.0e0) * ceil(res / 112.0e0) * 170").replace(
    "LOW", "(CASE WHEN target < 50 THEN 0.5e0 WHEN target < 100 THEN 0.7e0 WHEN target < 3000 THEN 0.8e0 WHEN target < 5000 THEN 0.9e0 ELSE 0.95e0 END)"
).replace("HIGH", "(CASE WHEN target < 50 THEN 2.0e0 WHEN target < 100 THEN 1.5e0 WHEN target < 3000 THEN 1.25e0 WHEN target < 5000 THEN 1.12e0 ELSE 1.05e0 END)")
_B = _CANDIDATES.replace("RATIO", "2.0e0").replace("PER", "greatest(1, floor(res * res / 1024.0e0))").replace(
    "LOW", "(CASE WHEN target < 50 THEN 0.5e0 WHEN target < 100 THEN 0.7e0 WHEN target < 3000 THEN 0.8e0 WHEN target < 5000 THEN 0.9e0 WHEN target < 10000 THEN 0.93e0 ELSE 0.95e0 END)"
).replace("HIGH", "(CASE WHEN target < 50 THEN 2.0e0 WHEN target < 100 THEN 1.5e0 WHEN target < 3000 THEN 1.25e0 WHEN target < 5000 THEN 1.12e0 WHEN target < 10000 THEN 1.08e0 ELSE 1.05e0 END)")


def _targets(spark, sf_dir, ratio=2.0):
    t = table(spark, sf_dir, "documents").select(L.text_tokens(F.col("text")).alias("k")).distinct()
    return t.select("k", (F.col("k") / ratio).alias("target"), F.col("k").alias("tokens"), F.lit(ratio).alias("ratio"), F.array().cast(S.USED).alias("used"))


@query("layout_search_a", f"""
WITH {_RES}, {_TARGETS}, {_A},
s AS (SELECT *, round(1.0e0 / (1.0e0 + off * 2.0e0) * (CASE WHEN fill >= 0.8e0 THEN 1.0e0 WHEN fill >= 0.2e0 THEN 0.2e0 + fill ELSE 0.1e0 END) * bonus / pow(pages::DOUBLE, 0.3e0), 12) AS score FROM c5),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, res, pages) AS n FROM s)
SELECT t.k, CAST(coalesce(res, 112) AS INTEGER) AS res, CAST(coalesce(font, 4) AS INTEGER) AS font, CAST(coalesce(pages, 1) AS INTEGER) AS pages FROM t LEFT JOIN b ON b.k = t.k AND b.n = 1""")
def layout_search_a(spark, sf_dir):
    return S.search_a(_targets(spark, sf_dir))


@query("layout_search_b", f"""
WITH {_RES}, {_TARGETS}, {_B},
s0 AS (SELECT *, 1.0e0 / (1.0e0 + off * (CASE WHEN target < 50 THEN 1.0e0 WHEN target < 100 THEN 1.5e0 WHEN target < 3000 THEN 2.0e0 WHEN target < 5000 THEN 2.5e0 WHEN target < 10000 THEN 3.0e0 ELSE 3.5e0 END)) AS fit,
  CASE WHEN fill >= 0.8e0 THEN 1.0e0 WHEN fill >= 0.2e0 THEN 0.2e0 + (fill - 0.2e0) * (0.8e0 / 0.6e0) WHEN fill >= 0.1e0 THEN 0.05e0 ELSE 0.01e0 END AS tight, CASE WHEN fill >= 0.2e0 THEN 0.9e0 ELSE 0.5e0 END AS loose, bonus * 1.2e0 AS extra FROM c5),
s1 AS (SELECT *, (CASE WHEN target < 50 THEN pow(fit, 2.5e0) * pow(loose, 0.2e0) * extra WHEN target < 100 THEN pow(fit, 1.5e0) * pow(tight, 0.75e0) * extra ELSE fit * tight * extra * (CASE WHEN target >= 5000 AND font < 8 THEN 0.8e0 ELSE 1.0e0 END) END) / pow(pages::DOUBLE, 0.3e0) AS v FROM s0),
s AS (SELECT k, res, font, pages, round(CASE WHEN target < 1000 AND pages > 2 THEN v * 0.01e0 ELSE v END, 12) AS score FROM s1),
p0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, res, pages) AS n FROM s) WHERE n = 1),
m1 AS (SELECT s.*, row_number() OVER (PARTITION BY s.k ORDER BY s.score DESC, s.res, s.pages) AS n FROM s JOIN p0 ON p0.k = s.k WHERE p0.res >= 900 AND p0.font < 10 AND s.pages > p0.pages),
p1 AS (SELECT p0.k, coalesce(m1.res, p0.res) AS res, coalesce(m1.font, p0.font) AS font, coalesce(m1.pages, p0.pages) AS pages FROM p0 LEFT JOIN m1 ON m1.k = p0.k AND m1.n = 1),
m2 AS (SELECT s.*, row_number() OVER (PARTITION BY s.k ORDER BY s.score DESC, s.res, s.pages) AS n FROM s JOIN p1 ON p1.k = s.k WHERE p1.res >= 900 AND p1.font < 10 AND s.pages > p1.pages),
p2 AS (SELECT p1.k, coalesce(m2.res, p1.res) AS res, coalesce(m2.font, p1.font) AS font, coalesce(m2.pages, p1.pages) AS pages FROM p1 LEFT JOIN m2 ON m2.k = p1.k AND m2.n = 1),
m3 AS (SELECT s.*, row_number() OVER (PARTITION BY s.k ORDER BY s.score DESC, s.res, s.pages) AS n FROM s JOIN p2 ON p2.k = s.k WHERE p2.res >= 900 AND p2.font < 10 AND s.pages > p2.pages),
p3 AS (SELECT p2.k, coalesce(m3.res, p2.res) AS res, coalesce(m3.font, p2.font) AS font, coalesce(m3.pages, p2.pages) AS pages FROM p2 LEFT JOIN m3 ON m3.k = p2.k AND m3.n = 1)
SELECT t.k, CAST(coalesce(res, 112) AS INTEGER) AS res, CAST(coalesce(font, 3) AS INTEGER) AS font, CAST(coalesce(pages, 1) AS INTEGER) AS pages FROM t LEFT JOIN p3 ON p3.k = t.k""")
def layout_search_b(spark, sf_dir):
    return S.search_b(_targets(spark, sf_dir))


@query("compression_plan")
def compression_plan(spark, sf_dir):
    """Layouts of all documents at ratios 1 to 8, with costs and warnings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", L.text_tokens(F.col("text")).alias("tokens"), *(c.alias(n) for n, c in L.structure(F.col("text")).items()))
    plans = S.plan_ratios(docs)
    cost = F.col("pages") * L.image_tokens_b(F.col("res"), F.col("res"))
    fill = L.fill_rate(F.col("font"), F.col("res"), F.col("pages"), F.col("num_lines"), F.col("avg_line_chars"))
    return docs.join(plans, "tokens").select("doc_id", "ratio", "res", "font", "pages", cost.alias("cost"), F.array_join(L.layout_warnings(cost, F.col("tokens") / F.col("ratio"), fill, F.col("font")), ",").alias("warnings"))


@query("layout_search_fitted")
def layout_search_fitted(spark, sf_dir):
    """Layouts at ratio 2 from each document's own line structure, font fitted in closed form."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), L.text_tokens(F.col("text")).alias("tokens"), *(c.alias(n) for n, c in L.structure(F.col("text")).items()), L.line_lengths(F.col("text")).alias("sizes"))
    docs = docs.withColumns({"target": F.col("tokens") / 2, "ratio": F.lit(2.0), "used": F.array().cast(S.USED)})
    return S.search_fitted(docs)


@query("page_rows", """
WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM benchmark),
c AS (SELECT item_id, pos, line, unnest(range(0, greatest(1, CAST(ceil(length(line) / 36.0e0) AS BIGINT)))) AS i FROM l),
n AS (SELECT item_id, substr(line, i * 36 + 1, 36) AS text, row_number() OVER (PARTITION BY item_id ORDER BY pos, i) - 1 AS k FROM c)
SELECT item_id, CAST(k // 22 + 1 AS INTEGER) AS page, CAST(k % 22 AS INTEGER) AS "row", text, CAST(2 AS INTEGER) AS x, CAST(2 + k % 22 * 10 AS INTEGER) AS y FROM n""")
def page_rows(spark, sf_dir):
    """Printed rows of benchmark items on pages of 224 with font 10: 36 characters, 22 rows."""
    out = rendering.page_rows(table(spark, sf_dir, "benchmark").select("item_id", "text").withColumnRenamed("text", "code"), "code", F.lit(224), F.lit(10))
    return out.select("item_id", "page", F.col("row").cast("int"), "text", F.col("x").cast("int"), F.col("y").cast("int"))


@query("wrapped_lines", """
WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT item_id, CAST(sum(greatest(1, ceil(length(line) / 40.0e0))) AS BIGINT) AS n_rows FROM l GROUP BY item_id""")
def wrapped_lines(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(X.wrap_lines(F.col("text"), 40)).cast("long").alias("n_rows"))


@query("page_choice", """
WITH p AS (SELECT page_id, page_id % 4 + 1 AS base, 700 + page_id % 5 * 100 AS r2, 800 + page_id % 3 * 100 AS r1 FROM pages)
SELECT page_id, CAST(CASE WHEN base >= 2 AND r2 > 980 THEN 2 WHEN r1 > 980 THEN 1 WHEN r2 > 980 THEN base ELSE 1 END AS INTEGER) AS pages, floor(12.0e0 * r1 / r2) AS font FROM p""")
def page_choice(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4 + 1).alias("base"), (700 + F.col("page_id") % 5 * 100).alias("r2"), (800 + F.col("page_id") % 3 * 100).alias("r1"))
    return p.select("page_id", L.page_choice(F.col("base"), F.col("r2"), F.col("r1"), F.col("r2")).alias("pages"), L.scaled_font(F.lit(12), F.col("r1"), F.col("r2")).cast("double").alias("font"))


@query("image_geometry", """
SELECT page_id, CAST(greatest(1, floor((100 + page_id % 900) / 1.5e0)) AS BIGINT) AS w, CAST(greatest(1, floor((50 + page_id % 70) / 1.5e0)) AS BIGINT) AS h,
  greatest(0, page_id - 50) AS image_tokens, CAST(greatest(800, floor((page_id % 200) * 18 * 0.6e0) + 40, floor((page_id % 90) * 18 * 1.2e0) + 40) AS BIGINT) AS canvas FROM pages""")
def image_geometry(spark, sf_dir):
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages").withColumn("g", L.corruption_size(100 + i % 900, 50 + i % 70, F.lit(1.5)))
    return p.select("page_id", "g.w", "g.h", L.image_token_estimate(i, F.lit(50)).alias("image_tokens"), L.demo_canvas(i % 200, i % 90).cast("long").alias("canvas"))
