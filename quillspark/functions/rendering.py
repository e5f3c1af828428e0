"""Coloured tokens and page geometry of code, as rows; pixels are a consumer's matter."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from quillspark.functions import layout as L

# Colours by token kind; the first key that a token's kind contains applies.
MODERN = {
    "Keyword": "#AF00DB", "Keyword.Declaration": "#0000FF", "Keyword.Type": "#0000FF", "Keyword.Constant": "#0000FF", "Operator.Word": "#0000FF",
    "Name.Function": "#795E26", "Name.Builtin": "#795E26", "Name.Class": "#267F99", "Name": "#000000", "Name.Variable": "#001080", "Name.Attribute": "#001080",
    "String": "#A31515", "String.Doc": "#008000", "Number": "#098658", "Comment": "#008000", "Operator": "#000000", "Punctuation": "#000000", "Error": "#FF0000",
}
LIGHT = {
    "Keyword": "#0000FF", "Name.Function": "#795E26", "Name.Builtin": "#795E26", "Name.Class": "#267F99", "Name": "#000000", "String": "#A31515",
    "String.Doc": "#008000", "Number": "#098658", "Comment": "#008000", "Operator": "#000000", "Punctuation": "#000000", "Error": "#FF0000",
}
# The pipelines' themes: a token takes the first key that it is or descends from.
MODERN_B = {
    "Keyword": "#AF00DB", "Operator.Word": "#0000FF", "Name.Function": "#795E26", "Name.Builtin": "#795E26", "Name.Class": "#267F99", "Name": "#000000",
    "Literal.String": "#A31515", "Literal.Number": "#098658", "Comment": "#008000", "Operator": "#000000", "Punctuation": "#000000", "Error": "#FF0000",
    "Generic.Deleted": "#A31515", "Generic.Inserted": "#008000",
}
LIGHT_B = {
    "Keyword": "#0000FF", "Name": "#000000", "Literal.String": "#A31515", "Literal.Number": "#098658", "Comment": "#008000", "Operator": "#000000",
    "Punctuation": "#000000", "Error": "#FF0000", "Generic": "#000000", "Other": "#000000", "Text": "#000000",
}
TOKEN = ArrayType(StructType().add("text", StringType()).add("color", StringType()))


def color_of(kind: str, theme: dict) -> str:
    return next((c for k, c in theme.items() if k in kind), "#000000")


def color_below(kind: str, theme: dict) -> str:
    """Colour of the first key that a kind such as Token.Name.Function equals or descends from."""
    path = kind.removeprefix("Token.")
    return next((c for k, c in theme.items() if path == k or path.startswith(k + ".")), "#000000")


def _spans(code: str, language: str | None, color, lexers: dict):
    """Pairs of text and color(kind); lexers keeps those of the languages seen."""
    try:
        from pygments import lex
        from pygments.lexers import get_lexer_by_name, guess_lexer
        from pygments.util import ClassNotFound
    except ImportError:
        return [(code, "#000000")]
    lexer = lexers.get(language)
    if lexer is None:
        try:
            lexer = get_lexer_by_name(language) if language else guess_lexer(code)
        except ClassNotFound:
            lexer = get_lexer_by_name("python")
        if language:
            lexers[language] = lexer
    return ((t, color(kind)) for kind, t in lex(code, lexer))


class _Colors(dict):
    """Token kinds to their colours, each found once."""

    def __init__(self, theme: dict, color):
        super().__init__()
        self.find = lambda kind: color(str(kind), theme)

    def __missing__(self, kind) -> str:
        value = self[kind] = self.find(kind)
        return value


def coloured(code: str, language: str | None, theme: dict, color=color_of) -> list[dict]:
    return [{"text": t, "color": c} for t, c in _spans(code, language, _Colors(theme, color).__getitem__, {})]


#: Tokens that are Python objects at a time; those before them are Arrow's.
PIECE = 1 << 15


def token_array(code: pa.Array, language: pa.Array, theme: dict, color=color_of) -> pa.Array:
    """The coloured tokens of each row as an Arrow list, text by text; null for null."""
    colors, lexers = _Colors(theme, color).__getitem__, {}
    ends, missing, texts, shades, held, held_shades = [0], [], [], [], [], []

    def pack():
        texts.append(pa.array(held, pa.string()))
        shades.append(pa.array(held_shades, pa.string()))
        held.clear()
        held_shades.clear()

    n = 0
    for c, lang in zip(code, language, strict=True):
        c = c.as_py()
        missing.append(c is None)
        for t, shade in () if c is None else _spans(c, lang.as_py(), colors, lexers):
            held.append(t)
            held_shades.append(shade)
            n += 1
            if len(held) >= PIECE:
                pack()
        ends.append(n)
    pack()
    fields = [pa.concat_arrays(texts), pa.concat_arrays(shades)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["text", "color"]), mask=pa.array(missing, pa.bool_()))


def syntax_tokens(theme: str = "light", variant: str = "a"):
    """Arrow function (code, language) to the ordered coloured tokens."""
    chosen = {"a": (LIGHT, MODERN), "b": (LIGHT_B, MODERN_B)}[variant][theme == "modern"]
    color = color_of if variant == "a" else color_below

    @F.arrow_udf(TOKEN)
    def run(code: pa.Array, language: pa.Array) -> pa.Array:
        return token_array(code, language, chosen, color)

    return run


def page_rows(docs: DataFrame, code: str, res: Column, font: Column, line_height: float = 1.0) -> DataFrame:
    """A row for each printed row of a text: page, row, text, x and y.

    Lines wrap at the characters of a row and pages turn when full; a blank line takes a row."""
    margin = F.floor(res * L.MARGIN).cast("int")
    area = res - 2 * margin
    c = F.greatest(F.lit(1), F.floor(area / (font * L.CHAR_WIDTH))).cast("int")
    height = F.greatest(F.lit(1), F.floor(font * line_height)).cast("int")
    m = F.greatest(F.lit(1), F.floor(area / height)).cast("int")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(s) / c) - 1).cast("int")), lambda i: F.substring(s, i * c + 1, c))
    rows = docs.select(*[x for x in docs.columns if x != code], F.posexplode(F.flatten(F.transform(F.split(F.col(code), "\n"), cut))).alias("at", "text"), m.alias("_m"), margin.alias("_margin"), height.alias("_h"))
    return rows.select(*[x for x in docs.columns if x != code], (F.floor(F.col("at") / F.col("_m")) + 1).cast("int").alias("page"), F.pmod("at", "_m").alias("row"), "text", F.col("_margin").alias("x"), (F.col("_margin") + F.pmod("at", "_m") * F.col("_h")).alias("y"))


def content_box(rows: DataFrame, keys: list[str], font: Column, keep: int = 0) -> DataFrame:
    """Box of the printed letters of each page, widened by ``keep``; a page without letters has none."""
    width = F.length(F.rtrim("text")) * font * L.CHAR_WIDTH
    inked = rows.where(F.trim("text") != "")
    left = F.length("text") - F.length(F.ltrim("text"))
    return inked.groupBy(*keys, "page").agg((F.min(F.col("x") + left * font * L.CHAR_WIDTH) - keep).alias("left"), (F.min("y") - keep).alias("top"), (F.max(F.col("x") + width) + keep).alias("right"), (F.max(F.col("y") + font) + keep).alias("bottom"))


def pair_rows(pairs: DataFrame, res: Column, font: Column, gap: int = 10) -> DataFrame:
    """Printed rows of pairs(file, left, right) side by side: each side has half the width, pages by number.

    The right side's x lies behind the left half and the gap; the longer side has the more pages."""
    half = F.floor((res - gap) / 2)
    side = lambda name, shift: page_rows(pairs.select("file", F.col(name).alias("code")), "code", half, font).select("file", F.lit(name).alias("side"), "page", "row", "text", (F.col("x") + shift).alias("x"), "y")
    return side("left", F.lit(0)).unionByName(side("right", half + gap))
