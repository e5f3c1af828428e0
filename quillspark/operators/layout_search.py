"""Search for page size, font and page count that cost a wanted number of tokens.

Searches depend only on (target tokens, text tokens, ratio, used sizes), so callers search distinct
combinations once and join the answer back; candidates never multiply documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import layout as L
from quillspark.scratch import checkpointed

# Upper bound of target tokens, tolerated shares, penalty (variant b).
BANDS_A = ((50, 0.5, 2.0), (100, 0.7, 1.5), (3000, 0.8, 1.25), (5000, 0.9, 1.12), (None, 0.95, 1.05))
BANDS_B = ((50, 0.5, 2.0, 1.0), (100, 0.7, 1.5, 1.5), (3000, 0.8, 1.25, 2.0), (5000, 0.9, 1.12, 2.5), (10000, 0.93, 1.08, 3.0), (None, 0.95, 1.05, 3.5))
USED = "array<struct<res:int,pages:int>>"


def _by_band(bands, at: int) -> Column:
    """The bands' value for the column ``target``; as SQL text, which is one step for the analyser."""
    cases = " ".join(f"WHEN target < {band[0]} THEN {float(band[at])}D" for band in bands[:-1])
    return F.expr(f"CASE {cases} ELSE {float(bands[-1][at])}D END")


def _chars() -> Column:
    return F.when(F.col("tokens") > 0, F.col("tokens") * L.CHARS_PER_TOKEN).otherwise(10000.0)


def _area_font(line_height: float = 1.0) -> Column:
    """Font for which the text's area is that of its pages."""
    inner = F.col("res") - 2 * (F.col("res") * L.MARGIN)
    size = F.sqrt(inner * inner * F.col("pages") / (_chars() * 0.6 * line_height))
    return F.greatest(F.lit(L.MIN_FONT), F.least(F.lit(L.MAX_FONT), F.floor(size).cast("int")))


def candidates(targets: DataFrame, per_image, bands, page_limit: int = 100, line_height: float = 1.0) -> DataFrame:
    """targets(k, target, tokens, ratio, used) with a row for each feasible (res, pages)."""
    target = F.col("target")
    rows = targets.withColumn("res", F.explode(L.resolutions())).withColumn("per", per_image(F.col("res"), F.col("res")))
    low = F.greatest(F.lit(1), F.ceil(target * _by_band(bands, 1) / F.col("per")))
    high = F.least(F.floor(target * _by_band(bands, 2) / F.col("per")), F.lit(page_limit))
    rows = rows.withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).where("low <= high").withColumn("pages", F.explode(F.sequence("low", "high")))
    inner = F.col("res") - 2 * (F.col("res") * L.MARGIN)
    area = inner * inner * F.col("pages")
    chars = _chars()
    rows = rows.withColumn("font", _area_font(line_height)).withColumn("fill", chars * ((F.col("font") * 0.6) * (F.col("font") * line_height)) / area)
    rows = rows.withColumn("off", F.abs(F.when(target > 0, F.col("pages") * F.col("per") / target).otherwise(1.0) - 1.0))
    return rows.withColumn("fresh", ~F.coalesce(F.array_contains("used", F.struct(F.col("res").cast("int").alias("res"), F.col("pages").cast("int").alias("pages"))), F.lit(False)))


_BONUS = f"(1.0D + (res - {L.SMALLEST}) / {float(L.LARGEST - L.SMALLEST)}D)"
_FRESH = "CASE WHEN fresh THEN 1.0D ELSE 0.95D END"
_STRONG = "(target < 50 OR coalesce(ratio >= 4.0D, false))"
_LOOSE = "CASE WHEN fill >= 0.2D THEN 0.9D ELSE 0.5D END"


def score_a() -> Column:
    """Over candidates(): token match, fill, preference for large pages and for few."""
    fill = "CASE WHEN fill >= 0.8D THEN 1.0D WHEN fill >= 0.2D THEN 0.2D + fill ELSE 0.1D END"
    return F.expr(f"1.0D / (1.0D + off * 2.0D) * {fill} * {_BONUS} / pow(pages, 0.3D) * {_FRESH}")


def _score(tight: str, bonus: str, per_page: str) -> Column:
    """The pipelines' score over candidates() with the column ``match``, the token match of the band."""
    extra = f"({bonus} * CASE WHEN ratio <= 2.0D THEN 1.2D ELSE 1.0D END)"
    small = "CASE WHEN target >= 5000 AND font < 8 THEN 0.8D ELSE 1.0D END"
    by_target = f"CASE WHEN {_STRONG} THEN pow(match, 2.5D) * pow({_LOOSE}, 0.2D) * {extra} WHEN target < 100 THEN pow(match, 1.5D) * pow({tight}, 0.75D) * {extra} ELSE match * {tight} * {extra} * {small} END"
    return F.expr(f"{by_target} {per_page} * CASE WHEN target < 1000 AND pages > 2 THEN 0.01D ELSE 1.0D END * {_FRESH}")


def score_b() -> Column:
    tight = "CASE WHEN fill >= 0.8D THEN 1.0D WHEN fill >= 0.2D THEN 0.2D + (fill - 0.2D) * (0.8D / 0.6D) WHEN fill >= 0.1D THEN 0.05D ELSE 0.01D END"
    return _score(tight, _BONUS, "/ pow(pages, 0.3D)")


def score_fitted() -> Column:
    tight = "CASE WHEN fill >= 0.9D THEN 1.0D WHEN fill >= 0.2D THEN 0.2D + (fill - 0.2D) * (0.8D / 0.7D) WHEN fill >= 0.1D THEN 0.05D ELSE 0.01D END"
    bonus = f"(1.0D + (res - {L.SMALLEST}) / {float(L.LARGEST - L.SMALLEST)}D * CASE WHEN target < 1000 THEN 1.0D WHEN target >= 3000 THEN 0.5D ELSE 0.3D END)"
    return _score(tight, bonus, "")


def _with_match(rows: DataFrame) -> DataFrame:
    return rows.withColumn("match", 1.0 / (1.0 + F.col("off") * _by_band(BANDS_B, 3)))


def _rank() -> Column:
    """A candidate as one number: its score to twelve digits, then the smaller page, then fewer pages.

    A number, unlike a struct, is maximised by hash aggregation, so candidates are never sorted."""
    at = F.when(F.col("res") < L.SMALLEST, F.col("res") / 14).otherwise(8 + (F.col("res") - L.SMALLEST) / 28).cast("long")
    score = F.round(F.round("score", 12) * 1e12).cast("long")
    return F.shiftleft(score, 21) + F.shiftleft(255 - at, 13) + (8191 - F.col("pages"))


def _best(scored: DataFrame, by: list[str]) -> DataFrame:
    """The candidate of the highest rank with its tokens."""
    best = scored.groupBy(*by).agg(F.max(_rank()).alias("rank"), F.max("tokens").alias("tokens"))
    at = 255 - F.shiftright("rank", 13).bitwiseAND(255)
    res = F.when(at < 8, at * 14).otherwise(L.SMALLEST + (at - 8) * 28)
    return best.withColumn("res", res.cast("int")).withColumn("pages", (8191 - F.col("rank").bitwiseAND(8191)).cast("int"))


def search_a(targets: DataFrame, page_limit: int = 100) -> DataFrame:
    """targets(k, target, tokens, ratio, used) to k, res, font, pages; 112, 4, 1 where nothing is feasible."""
    scored = candidates(targets, L.image_tokens_a, BANDS_A, page_limit).withColumn("score", score_a())
    best = _best(scored, ["k"]).select("k", "res", _area_font().alias("font"), "pages")
    return targets.select("k").join(best, "k", "left").select("k", F.coalesce("res", F.lit(112)).alias("res"), F.coalesce("font", F.lit(4)).alias("font"), F.coalesce("pages", F.lit(1)).alias("pages"))


def search_b(targets: DataFrame, page_limit: int = 100, retries: int = 3) -> DataFrame:
    """As search_a with the pipelines' scores; 112, 3, 1 where nothing is feasible.

    While a page of 900 or more has a font under 10, the best candidate of more pages replaces it, up to
    ``retries`` times. The best of each page count, at most page_limit of them, is all that this needs."""
    scored = _with_match(candidates(targets, L.image_tokens_b, BANDS_B, page_limit)).withColumn("score", score_b())
    per_pages = _best(scored.withColumn("n", F.col("pages")), ["k", "n"]).withColumn("font", _area_font())
    per_pages = per_pages.groupBy("k").agg(F.collect_list(F.struct("rank", "res", "pages", "font")).alias("all"))

    def again(cur, _):
        more = F.filter("all", lambda c: c["pages"] > cur["pages"])
        return F.when((cur["res"] >= 900) & (cur["font"] < 10) & (F.size(more) > 0), F.array_max(more)).otherwise(cur)

    best = per_pages.select("k", F.aggregate(F.sequence(F.lit(1), F.lit(retries)), F.array_max("all"), again).alias("b"))
    return targets.select("k").join(best, "k", "left").select("k", F.coalesce("b.res", F.lit(112)).alias("res"), F.coalesce("b.font", F.lit(3)).alias("font"), F.coalesce("b.pages", F.lit(1)).alias("pages"))


def search_fitted(docs: DataFrame, page_limit: int = 100) -> DataFrame:
    """docs(k, target, tokens, ratio, used, num_lines, max_line_chars, avg_line_chars, sizes) to k, res, font, pages.

    Candidates take the font for which all lines fit and none wraps; the best one's font is then the largest
    whose pages, in closed form, are within its count. 112 and the largest one-page font where none is feasible."""
    rows = candidates(docs, L.image_tokens_b, BANDS_B, page_limit)
    rows = rows.withColumn("font", L.optimal_font(F.col("res"), F.col("pages"), F.col("num_lines"), F.col("max_line_chars")).cast("int"))
    rows = rows.withColumn("fill", L.fill_rate(F.col("font"), F.col("res"), F.col("pages"), F.col("num_lines"), F.col("avg_line_chars")))
    poor = F.expr("CASE WHEN target >= 10000 THEN fill < 0.03D AND font < 6 WHEN target >= 3000 THEN fill < 0.1D AND font < 5 ELSE false END")
    rows = _with_match(rows.where(~poor)).withColumn("score", score_fitted())
    best = _best(rows, ["k"]).select("k", "res", "pages")
    found = docs.select("k", "sizes", "num_lines", "max_line_chars").join(best, "k", "left")
    first = L.optimal_font(F.col("res"), F.col("pages"), F.col("num_lines"), F.col("max_line_chars"))
    found = found.select("k", "sizes", F.coalesce("res", F.lit(112)).alias("res"), F.coalesce("pages", F.lit(1)).alias("pages"), F.when(F.col("res").isNotNull(), first).alias("f"))
    found = found.withColumn("fitted", L.max_font(F.col("sizes"), F.col("res"), F.col("pages")))
    fits = L.layout_pages(F.col("sizes"), F.col("res"), F.col("fitted"))[0] <= F.col("pages")
    return found.select("k", "res", F.when(fits, F.col("fitted")).otherwise(F.coalesce("f", F.lit(3))).cast("int").alias("font"), "pages")


def plan_ratios(docs: DataFrame, ratios=(1.0, 2.0, 4.0, 8.0), search=search_b) -> DataFrame:
    """docs(tokens) to a layout for each distinct token count and ratio, smallest ratio first.

    What one ratio takes is a used size for the next, so the ratios are chained; rows are distinct token
    counts, not documents. Ratio 0 is one blank page of 14."""
    state = docs.select(F.col("tokens").cast("long").alias("tokens")).distinct().withColumn("used", F.array().cast(USED))
    plans = None
    for ratio in sorted(ratios):
        if ratio == 0:
            got = state.select("tokens", F.lit(0.0).alias("ratio"), F.lit(14).alias("res"), F.lit(0).alias("font"), F.lit(1).alias("pages"))
        else:
            targets = state.select(F.col("tokens").alias("k"), (F.col("tokens") / ratio).alias("target"), "tokens", F.lit(float(ratio)).alias("ratio"), "used")
            found = checkpointed(search(targets).withColumnRenamed("k", "tokens"))  # the next ratio reads it twice
            state = state.join(found, "tokens").select("tokens", F.concat("used", F.array(F.struct("res", "pages"))).alias("used"))
            got = found.select("tokens", F.lit(float(ratio)).alias("ratio"), "res", "font", "pages")
        plans = got if plans is None else plans.unionByName(got)
    return plans
