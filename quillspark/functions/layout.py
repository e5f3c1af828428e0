"""Token costs, page estimates and layout limits as column arithmetic.

Where two variants of a formula are in use, ``_a`` is the library's and ``_b`` the task pipelines'.
Glyphs advance 0.6 of the font size, the width that the estimates use too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import let

# Fixed values of the cost model.
CHARS_PER_TOKEN, CHAR_WIDTH, MARGIN = 3.5, 0.6, 0.01
MIN_FONT, MAX_FONT = 4, 150
SMALLEST, LARGEST = 112, 4480


def _int(x: Column) -> Column:
    return F.floor(x).cast("long")


def text_tokens(x: Column) -> Column:
    """A quarter of the characters, at least one; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(x, F.lit(""))) / 4)).cast("long")


def image_tokens_a(w: Column, h: Column) -> Column:
    return (F.ceil(w / 112) * F.ceil(h / 112) * 170).cast("long")


def image_tokens_b(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(1), _int(w * h / 1024)).cast("long")


def patch_tokens(w: Column, h: Column) -> Column:
    """170 and two per 14 x 14 patch up to 100; unknown sizes count 170."""
    return F.coalesce(170 + F.least(2 * F.ceil(w / 14) * F.ceil(h / 14), F.lit(100)), F.lit(170)).cast("long")


def resolutions() -> Column:
    """All page sizes: 14 to 98 by 14, then 112 to 4480 by 28."""
    return F.concat(F.sequence(F.lit(14), F.lit(98), F.lit(14)), F.sequence(F.lit(SMALLEST), F.lit(LARGEST), F.lit(28)))


def line_lengths(x: Column) -> Column:
    return F.transform(F.split(x, "\n"), F.length)


def structure(x: Column) -> dict[str, Column]:
    """Lines, longest and mean line, characters."""
    sizes = line_lengths(x)  # plain expressions: the projection computes it once
    return {"num_lines": F.size(sizes).cast("long"), "max_line_chars": F.array_max(sizes).cast("long"), "avg_line_chars": F.aggregate(sizes, F.lit(0).cast("long"), lambda s, n: s + n) / F.size(sizes), "total_chars": F.length(x).cast("long")}


def _inner(res: Column) -> Column:
    return res - 2 * (res * MARGIN)


def _grid(res: Column, font: Column, line_height: float) -> tuple[Column, Column]:
    """Characters in a line and lines on a page."""
    return F.greatest(F.lit(1), _int(_inner(res) / (font * CHAR_WIDTH))), F.greatest(F.lit(1), _int(_inner(res) / (font * line_height)))


def page_estimate_a(tokens: Column, res: Column, font: Column, line_height: float = 1.0) -> Column:
    per_line, per_page = _grid(res, font, line_height)
    return F.when((font <= 0) | (res <= 0), 999).otherwise(F.greatest(F.lit(1), F.ceil(tokens * CHARS_PER_TOKEN * 1.3 / (per_line * per_page)))).cast("long")


def page_estimate_b(tokens: Column, res: Column, font: Column, line_height: float = 1.0) -> Column:
    """As variant a, with an overhead for newlines that grows with the line; no text is one page."""
    per_line, per_page = _grid(res, font, line_height)
    chars = tokens * CHARS_PER_TOKEN
    overhead = 1.3 + (chars / 50 * per_line * 0.3) / chars
    return F.when((font <= 0) | (res <= 0), 999).when(tokens <= 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(chars * overhead / (per_line * per_page)))).cast("long")


def initial_font(chars: Column, res: Column, line_height: float = 1.0) -> Column:
    """Font from the area, enlarged by a tenth and held within the limits."""
    size = _int(_int(F.sqrt(_inner(res) * _inner(res) * 0.95 / (chars * CHAR_WIDTH * line_height))) * 1.1)
    return F.when(chars <= 0, MAX_FONT).otherwise(F.least(F.lit(MAX_FONT), F.greatest(F.lit(MIN_FONT), size))).cast("long")


def horizontal_fill(res: Column, font: Column, line_chars=80) -> Column:
    per_line = _inner(res) / (font * CHAR_WIDTH)
    return F.when((font <= 0) | (res <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.5), line_chars / per_line)))


def fill_at_pages(tokens: Column, res: Column, pages: Column, line_chars: int = 80, line_height: float = 1.0) -> Column:
    chars = tokens * CHARS_PER_TOKEN / pages
    font = F.greatest(F.lit(float(MIN_FONT)), F.least(F.lit(float(MAX_FONT)), F.sqrt(_inner(res) * _inner(res) / (chars * CHAR_WIDTH * line_height))))
    return F.when((pages <= 0) | (res <= 0), 0.0).when(tokens <= 0, 1.5).otherwise(horizontal_fill(res, font, line_chars))


def token_ratio(pages: Column, per_image: Column, target: Column) -> Column:
    return F.when(target <= 0, 999.0).otherwise(pages * per_image / target)


def tokens_in_range(pages: Column, per_image: Column, target: Column, low: float = 0.9, high: float = 1.1) -> Column:
    return F.when(target <= 0, False).otherwise((pages * per_image / target).between(low, high))


def optimal_font(res: Column, pages: Column, num_lines: Column, max_line: Column, line_height: float = 1.0) -> Column:
    """Largest font for which all lines fit and the longest does not wrap."""
    tall = F.when(num_lines > 0, _inner(res) * pages / (num_lines * line_height)).otherwise(float(MAX_FONT))
    wide = F.when(max_line > 0, _inner(res) / (max_line * CHAR_WIDTH)).otherwise(float(MAX_FONT))
    return F.greatest(F.lit(MIN_FONT), F.least(F.lit(MAX_FONT), _int(F.least(tall, wide)))).cast("long")


def fill_rate(font: Column, res: Column, pages: Column, num_lines: Column, avg_line: Column, line_height: float = 1.0) -> Column:
    vertical = F.when(pages > 0, font * line_height * num_lines / (_inner(res) * pages)).otherwise(0.0)
    return F.least(F.lit(1.5), vertical, font * CHAR_WIDTH * avg_line / _inner(res))


def nearest_resolution(target: Column, per_image=image_tokens_a) -> Column:
    """Page size whose tokens are nearest to the target; ties go to the smallest."""
    scored = F.transform(resolutions(), lambda r: F.struct(F.abs(per_image(r, r) - target).alias("off"), r.alias("res")))
    return F.array_min(scored)["res"]


def nearest_larger(target: Column, per_image=image_tokens_b, tolerance: float = 1.4) -> Column:
    """As nearest_resolution, but the largest of those within 1.2 of the least difference if their
    tokens are within the tolerance of each other."""
    scored = F.transform(resolutions(), lambda r: F.struct(F.abs(per_image(r, r) - target).alias("off"), r.alias("res"), per_image(r, r).alias("tokens")))

    def choose(close):
        low, high = F.element_at(close, 1), F.element_at(close, -1)  # in order of size, so of tokens
        return F.when(high["tokens"] <= low["tokens"] * tolerance, high["res"]).otherwise(F.array_min(close)["res"])

    return let(scored, lambda all_: let(F.array_min(all_)["off"] * 1.2, lambda most: let(F.filter(all_, lambda s: s["off"] <= most), choose)))


def layout_pages(sizes: Column, res: Column, font: Column, line_height: float = 1.0) -> tuple[Column, Column]:
    """Pages and lines on the last page of text with these line lengths (array), in closed form.

    A line of n characters takes ceil(n / c) rows; every row after the first moves one line on, and a page
    turns when its lines are full."""
    margin = _int(res * MARGIN)
    area = res - 2 * margin
    c = F.greatest(F.lit(1), _int(area / (font * CHAR_WIDTH)))
    m = F.greatest(F.lit(1), _int(area / F.greatest(F.lit(1), _int(font * line_height))))
    wraps = let(c, lambda w: F.aggregate(sizes, F.lit(0).cast("long"), lambda s, n: s + F.greatest(F.lit(0), F.ceil(n / w) - 1)))
    turns = wraps + F.size(sizes) - 1
    return (1 + F.floor(turns / m)).cast("long"), F.pmod(turns, m).cast("long")


def max_font(sizes: Column, res: Column, pages: Column) -> Column:
    """Largest font of 4 to 150 whose layout needs at most these pages, 4 if none, by bisection."""

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("long")
        return F.when(acc["lo"] > acc["hi"], acc).otherwise(let(mid, lambda f: step(acc, f)))

    def step(acc, f):
        lower = F.struct(acc["lo"].alias("lo"), (f - 1).alias("hi"), acc["best"].alias("best"))
        return F.when(layout_pages(sizes, res, f)[0] <= pages, F.struct((f + 1).alias("lo"), acc["hi"].alias("hi"), f.alias("best"))).otherwise(lower)

    start = F.struct(F.lit(MIN_FONT).cast("long").alias("lo"), F.lit(MAX_FONT).cast("long").alias("hi"), F.lit(MIN_FONT).cast("long").alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, halve, lambda a: a["best"])


def two_column_layout(sizes: list[int], res: int, font: int, line_height: float = 1.0, gap: int = 10) -> tuple[int, float]:
    """Pages and fill of the last page where a narrow first column is followed by a second one.

    A page turns to its second column when the first is full and its widest row takes half the page at most."""
    if font <= 0:
        return 9999, 0.0
    margin, step = int(res * MARGIN), int(font * line_height)
    rows_per_column = int((res - 2 * margin) / step) if step > 0 else 1
    advance = font * CHAR_WIDTH
    first_width, second_start = (res - 2 * margin) // 2, res // 2 + gap // 2
    pages, column, row, widest = 1, 0, 0, 0.0

    def turn():
        nonlocal pages, column, row, widest
        row += 1
        if row >= rows_per_column:
            if column == 0 and widest <= res / 2:
                column = 1
            else:
                pages, column = pages + 1, 0
            row, widest = 0, 0.0

    for i, n in enumerate(sizes):
        if i:
            turn()
        while n > 0:
            room = max(1, int((first_width if column == 0 else res - margin - second_start) / advance))
            taken = min(n, room)
            widest = max(widest, taken * advance)
            n -= taken
            if n > 0:
                turn()
    whole = 2 * max(rows_per_column, 1)
    return pages, (rows_per_column * column + row) / whole


def corruption_size(w: Column, h: Column, ratio: Column) -> Column:
    """Size of a page after it is shrunk by a ratio."""
    return F.struct(F.greatest(F.lit(1), _int(w / ratio)).alias("w"), F.greatest(F.lit(1), _int(h / ratio)).alias("h"))


def demo_canvas(max_line: Column, num_lines: Column) -> Column:
    return F.greatest(F.lit(800), _int(max_line * 18 * 0.6) + 40, _int(num_lines * 18 * 1.2) + 40)


def page_choice(base_pages: Column, res_two: Column, res_one: Column, res_base: Column) -> Column:
    """Of 2 pages (if the base has them), 1 page and the base, the first whose size is above 980; else 1."""
    options = F.array(F.struct(F.lit(2).alias("pages"), F.when(base_pages >= 2, res_two).alias("res")), F.struct(F.lit(1).alias("pages"), res_one.alias("res")), F.struct(base_pages.cast("int").alias("pages"), res_base.alias("res")))
    return F.coalesce(F.try_element_at(F.filter(options, lambda o: o["res"] > 980), F.lit(1))["pages"], F.lit(1))


def scaled_font(font: Column, target: Column, base: Column) -> Column:
    return _int(font * target / base)


def image_token_estimate(prompt: Column, text: Column) -> Column:
    return F.greatest(F.lit(0), prompt - text)


def layout_warnings(tokens: Column, target: Column, fill: Column, font: Column) -> Column:
    return F.array_compact(F.array(F.when(F.abs(tokens - target) / target > 0.2, "tokens"), F.when(fill < 0.1, "fill"), F.when(font < 8, "font")))


def estimated_or_measured(measured: Column | None, estimate: Column) -> Column:
    """Tokens of a model's own processor where it gives them, else the estimate."""
    return estimate if measured is None else F.coalesce(measured, estimate)
