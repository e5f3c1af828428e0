"""Text functions from columns to columns; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.schemas import SYMBOLS

#: What counts as white space in scripts' ``strip``, within the ASCII range.
SPACE = r"[\x20\t\n\r\x0B\f\x1C-\x1F]"
_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
FENCE = "`" * 3
BOX_OPEN, BOX_CLOSE = "<|begin_of_box|>", "<|end_of_box|>"


def let(value: Column, use) -> Column:
    """use(value) with value computed once: conditions and lambdas would compute it again at each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"{SPACE}+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def lines(x: Column) -> Column:
    """Lines by the newline character only; an empty text is one empty line."""
    return F.split(x, "\n")


def split_lines(x: Column) -> Column:
    """Lines by any line end; a final line end opens no line and an empty text has none."""
    return let(F.split(x, _LINE_END), lambda got: F.when(F.element_at(got, -1) == "", F.slice(got, 1, F.size(got) - 1)).otherwise(got))


def _trim_blank_ends(got: Column) -> Column:
    """Drop empty strings at both ends of an array of right-stripped lines."""

    def cut(got):
        full = F.filter(F.transform(got, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
        none = F.array().cast("array<string>")
        return let(full, lambda at: F.when(F.size(at) == 0, none).otherwise(F.slice(got, F.element_at(at, 1) + 1, F.element_at(at, -1) - F.element_at(at, 1) + 1)))

    return let(got, cut)


def normalize_code(x: Column) -> Column:
    """Lines right-stripped, blank lines at head and tail dropped; null is empty."""
    return F.array_join(_trim_blank_ends(F.transform(lines(F.coalesce(x, F.lit(""))), rstrip)), "\n")


def normalize_demo(x: Column) -> Column:
    """The whole text stripped, then lines right-stripped and blank ends dropped."""
    return F.array_join(_trim_blank_ends(F.transform(split_lines(strip(F.coalesce(x, F.lit("")))), rstrip)), "\n")


def nonblank_lines(x: Column) -> Column:
    """Right-stripped lines without the blank ones."""
    return F.filter(F.transform(split_lines(F.coalesce(x, F.lit(""))), rstrip), lambda s: s != "")


def without_blank_lines(x: Column) -> Column:
    return F.array_join(nonblank_lines(x), "\n")


def clean_ocr(x: Column) -> Column:
    """Box markers removed, newlines at the ends removed, other white space kept."""
    return F.regexp_replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit(BOX_OPEN)), F.lit(BOX_CLOSE)), r"^\n+|\n+\z", "")


def render_text(x: Column, preserve_newlines: bool = True) -> Column:
    """Tabs to four spaces, newlines to a mark unless preserved, typographic dashes and dots to ASCII."""
    out = F.replace(x, F.lit("\t"), F.lit("    "))
    if not preserve_newlines:
        out = F.replace(out, F.lit("\n"), F.lit("⏎"))
    for mark, plain in (("–", "-"), ("—", "--"), ("…", "...")):
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def strip_fence(x: Column) -> Column:
    """A leading fence line and a closing one removed, if the text starts with a fence."""
    got = lines(x)
    body = F.slice(got, 2, F.size(got))
    shut = strip(F.element_at(body, -1)).startswith(FENCE)
    body = F.when(F.size(body) == 0, body).when(shut, F.slice(body, 1, F.size(body) - 1)).otherwise(body)
    return F.when(x.startswith(FENCE), F.array_join(body, "\n")).otherwise(x)


def _first_group(x: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without a match."""
    return F.element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), 1)


def element_or_null(array: Column, at: Column) -> Column:
    """element_at that gives null out of range and at 0."""
    return F.try_element_at(array, F.when(at != 0, at))


def extract_code(x: Column) -> Column:
    """Text between the last two fence lines; else the first fenced block; else a box; else the text stripped."""

    def between(got):
        def cut(at):
            first, last = F.element_at(at, -2), F.element_at(at, -1)
            return F.when(first + 1 < last, strip(F.array_join(F.slice(got, first + 2, last - first - 1), "\n")))

        marks = F.filter(F.transform(got, lambda s, i: F.when(F.contains(s, F.lit(FENCE)), i)), lambda i: i.isNotNull())
        return let(marks, lambda at: F.when(F.size(at) >= 2, cut(at)))

    fenced = strip(F.try_element_at(F.regexp_extract_all(x, F.lit(rf"(?s){FENCE}(?:python|Python)?\s*\n(.*?)\n?{FENCE}"), F.lit(1)), F.lit(1)))
    boxed = strip(F.try_element_at(F.regexp_extract_all(x, F.lit(r"(?s)<\|begin_of_box\|>(.*?)<\|end_of_box\|>"), F.lit(1)), F.lit(1)))
    whole = strip(x)
    plain = F.coalesce(fenced, boxed, whole)
    fenced_twice = let(between(lines(x)), lambda inner: F.when(inner.isNull(), plain).when(inner != "", inner).otherwise(whole))
    return F.when(is_blank(x), "").when(F.contains(x, F.lit(FENCE)), fenced_twice).otherwise(F.coalesce(boxed, whole))


def last_definition_line(code_lines: Column) -> Column:
    """1-based line of the last def or class, moved up over its decorators; null without any.

    Going up, blank and comment lines are passed over, and the highest decorator reached counts."""
    defs = F.filter(F.transform(code_lines, lambda s, i: F.when(F.ltrim(s).rlike(r"^(?:def|async\s+def|class)\s+"), i)), lambda i: i.isNotNull())
    last = F.try_element_at(defs, F.lit(-1))
    up = F.reverse(F.slice(code_lines, 1, last))
    bare = lambda s: F.regexp_replace(s, rf"^{SPACE}+", "")

    def walk(acc, s):
        at = acc["at"] - 1
        kind = bare(s)
        go = ~acc["done"] & (kind.startswith("@") | (kind == "") | kind.startswith("#"))
        return F.struct(at.alias("at"), F.when(~acc["done"] & kind.startswith("@"), at).otherwise(acc["start"]).alias("start"), (~go).alias("done"))

    start = F.aggregate(up, F.struct(last.alias("at"), last.alias("start"), F.lit(False).alias("done")), walk, lambda a: a["start"])
    return F.when(last.isNotNull(), start + 1)


def split_last_definition(code: Column) -> tuple[Column, Column]:
    """(background, current function) of Python code; without a definition all is current."""

    def cut(got):
        parts = lambda at: F.struct(F.array_join(F.slice(got, 1, at - 1), "\n").alias("background"), F.array_join(F.slice(got, at, F.size(got)), "\n").alias("current"))
        return let(last_definition_line(got), lambda at: F.when(at.isNotNull(), parts(at)))

    both = let(split_lines(code), cut)
    return F.coalesce(both["background"], F.lit("")), F.coalesce(both["current"], code)


def split_last_chunk(code: Column, chunk: Column) -> tuple[Column, Column]:
    """(text before the last occurrence of chunk, from there on)."""
    from_end = F.position(F.reverse(chunk), F.reverse(code)) - 1
    head = F.length(code) - from_end - F.length(chunk)
    found = F.contains(code, chunk) & (chunk != "")
    return F.when(found, F.substring(code, F.lit(1), head)).otherwise(""), F.when(found, F.substring(code, head + 1, F.length(code))).otherwise(code)


def split_pair(x: Column) -> Column:
    """Two code blocks of a file, separated by two or more blank lines, as struct(left, right), else null.

    Single blank lines within a block are dropped and further blocks ignored."""
    got = F.transform(split_lines(x), lambda s: F.when(strip(s) == "", F.lit(None)).otherwise(s))
    text = F.array_join(F.transform(got, lambda s: F.coalesce(F.concat(F.lit("x"), s), F.lit(""))), "\n")
    blocks = F.filter(F.split(text, r"\n{3,}"), lambda b: F.regexp_replace(b, r"\n", "") != "")
    lines_of = lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda s: s != ""), lambda s: F.substring(s, 2, 1 << 30)), "\n")
    return F.when(F.size(blocks) >= 2, F.struct(lines_of(F.element_at(blocks, 1)).alias("left"), lines_of(F.element_at(blocks, 2)).alias("right")))


def answer_letter(x: Column) -> Column:
    """A to H from a response: JSON answer, a lone letter, phrases, else the last letter that stands alone."""
    return let(strip(x), _letter)


def _letter(s: Column) -> Column:
    object_ = F.regexp_extract(s, r"(\{[^{}]*\})", 1)
    value = F.coalesce(*(F.get_json_object(object_, f"$.{k}") for k in ("answer", "Answer", "ANSWER")))
    phrases = (
        r"[Aa]nswer[\s:]*([A-Ha-h])\b", r"[Tt]he answer is[\s:]*([A-Ha-h])\b", r"[Cc]orrect answer[\s:]*([A-Ha-h])\b",
        r"\b([A-Ha-h])\s*[.:)]\s*$", r"^([A-Ha-h])\s*[.:)]", r"\b([A-Ha-h])\s+is correct",
    )
    found = [F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in phrases]
    lone = F.try_element_at(F.regexp_extract_all(s, F.lit(r"\b([A-Ha-h])\b"), F.lit(1)), F.lit(-1))
    return F.upper(F.coalesce(F.when(value.rlike("^[A-Ha-h]$"), value), F.when(s.rlike("^[A-Ha-h]$"), s), *found, lone))


def json_text(x: Column) -> Column:
    """The JSON that a response holds, out of a box or a fence, as text; null if it does not parse."""
    inner = lambda s, pattern: strip(F.coalesce(F.try_element_at(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), F.lit(1)), s))
    box, fence = r"(?s)<\|begin_of_box\|>(.*?)<\|end_of_box\|>", rf"(?s){FENCE}(?:json)?\s*\n(.*?)\n{FENCE}"
    unboxed = let(strip(x), lambda s: F.when(F.contains(s, F.lit(BOX_OPEN)), inner(s, box)).otherwise(s))
    bare = let(unboxed, lambda s: F.when(F.contains(s, F.lit(FENCE)), inner(s, fence)).otherwise(s))
    return let(bare, lambda s: F.when(F.try_parse_json(s).isNotNull(), s))


def json_flag(x: Column, key: str) -> Column:
    """Truth of a key in a response's JSON object: missing is false, an empty object or no JSON is null."""

    def truth(got):
        value = F.get_json_object(got, f"$.{key}")
        said = let(value, lambda v: ~(v.isNull() | v.isin("false", "0", "0.0", "", "null", "[]", "{}")))
        return F.when(got.isNotNull() & got.startswith("{") & ~got.rlike(r"^\{\s*\}$"), said)

    return let(json_text(x), truth)


def options_text(options: Column) -> Column:
    """``K. value`` lines of a map, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(options)), lambda k: F.concat(k, F.lit(". "), F.coalesce(options[k], F.lit("None")), F.lit("\n"))), "")


def symbol_count(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, SYMBOLS, ""))


def symbol_loss(ref: Column, hyp: Column) -> Column:
    """More than a fifth of the reference's symbols are missing."""
    return (symbol_count(ref) > 0) & (symbol_count(hyp) < 0.8 * symbol_count(ref))


def mask_key(key: Column) -> Column:
    """An API key with its middle hidden; null and empty stay empty."""
    n = F.length(key)
    short = F.concat(F.left(key, F.lit(2)), F.lit("..."), F.right(key, F.lit(2)))
    return F.when(key.isNull() | (key == ""), "").when(n <= 12, short).otherwise(F.concat(F.left(key, F.lit(6)), F.lit("..."), F.right(key, F.lit(6))))


def safe_filename(x: Column, default: str = "model", limit: int = 80) -> Column:
    """Runs of other characters to one underscore, at most 80 characters; blank gives the default."""
    s = strip(F.coalesce(x, F.lit("")))
    return F.when(s == "", F.lit(default)).otherwise(F.substring(F.regexp_replace(s, r"[^a-zA-Z0-9._-]+", "_"), 1, limit))


def flat_filename(x: Column) -> Column:
    return F.coalesce(F.replace(x, F.lit("/"), F.lit("_")), F.lit("unknown"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def ratio_of(path: Column) -> Column:
    """The number after ``_ratio`` in a file's name, 1 without."""
    tail = F.replace(F.nullif(F.regexp_extract(stem(path), r"^.*?_ratio(.*)$", 1), F.lit("")), F.lit("_"), F.lit("."))
    return F.coalesce(F.when(tail.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), tail.cast("double")), F.lit(1.0))


def page_of(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(stem(path), r"page_(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


def case_of(path: Column) -> Column:
    """The directory two levels above the file."""
    return F.try_element_at(F.split(path, "/"), F.lit(-3))


def language_of(path: Column) -> Column:
    """Language by extension (fixed values), Python where unknown."""
    known = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php"}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))), F.lit("python"))


def file_order(name: Column) -> Column:
    """Sort key of a file: the number before its extension, else the first number, else none (last)."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)\.\w+$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit(""))).cast("double")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(png|jpg|jpeg|webp)$")


def redact_images(messages: Column) -> Column:
    """In array<struct<type,text,image_url>> replace image payloads by a mark."""
    return F.transform(messages, lambda m: F.struct(m["type"].alias("type"), m["text"].alias("text"), F.when(m["type"] == "image_url", "<image omitted>").otherwise(m["image_url"]).alias("image_url")))


def wrap_lines(x: Column, width: int) -> Column:
    """Rows of at most width characters; newlines end rows and blank lines stay."""
    cut = lambda s: F.when(s == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / width).cast("int")), lambda i: F.substring(s, i * width + 1, F.lit(width))))
    return F.flatten(F.transform(lines(x), cut))


def trim_to_tokens(x: Column, most: int) -> tuple[Column, Column]:
    """(text cut to a token budget, its tokens) by the estimate of four characters a token."""
    cut = F.substring(x, 1, 4 * most)
    return cut, F.when(x.isNull() | (x == ""), 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(cut) / 4)))
