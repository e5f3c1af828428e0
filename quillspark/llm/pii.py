r"""Personal data, also where it is disguised: offset-preserving deobfuscation.

Four base detectors run on the text as it is. Then transducers rewrite the text: homoglyphs and full-width
forms to ASCII, zero-width characters away, spelled digits to digits, and at/dot disguises to ``@`` and
``.``. Every rewritten character keeps the source range it came from, so that spans found in the rewritten
text are mapped back to the source. Base spans always stay; a mapped span is added unless it touches a
span of its own kind.

Defined cases: null text is empty and has no spans; spans count code points, end exclusive; matches that
fail a test (parts over 255, Luhn, digit counts) are dropped and not retried; repeated rows repeat results;
detectors read each run of characters once, so very long texts take linear time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shared

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive repeats: giving digits back can never make these match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Latin look-alikes of Cyrillic and Greek letters, and marks like @ and . (fixed values).
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнАЕОРСУХІЈЅВНКМТαοενρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlkmtbhAEOPCYXIJSBHKMTaoevptuikABEZHIKMNOPTYX", strict=True)) | dict(zip("﹫。․‐‑‒–−", "@..-----", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
#: Digits as words in the languages of the corpus (fixed values).
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
#: At least this many digits in a row, spelled or not, before spelled ones are rewritten.
LEAST_DIGITS = 4
_SPELL = re.compile(rf"(?i)(?<!\w)(?:(?:{_WORDS})(?!\w)[\s,;-]{{0,3}}|[0-9](?=[\s,;-]{{0,3}}(?:[0-9]|(?:{_WORDS})(?!\w)))[\s,;-]{{0,3}}){{{LEAST_DIGITS - 1},}}+(?:(?:{_WORDS})(?!\w)|[0-9]+)?")
_ONE = re.compile(rf"(?i)(?<!\w)(?:{_WORDS})(?!\w)")
#: Letters that patterns without case take for s and i.
_FOLD = str.maketrans("ſıİ", "sii")
_AT = re.compile(r"(?i)\s{0,2}[\[({<]\s{0,2}(?:at|arroba|@)\s{0,2}[\])}>]\s{0,2}|\s{1,2}(?:at|arroba)\s{1,2}|\s{0,2}@\s{0,2}")
_DOT = r"(?:\s{0,2}[\[({<]\s{0,2}(?:dot|punto|point|punkt|\.)\s{0,2}[\])}>]\s{0,2}|\s{1,2}(?:dot|punto|point|punkt)\s{1,2}|\.)"
_HOST = re.compile(rf"(?i)[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+")
_DOTS = re.compile(rf"(?i){_DOT}")
_NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9]){_DOT}(?=[0-9])")
_PLUS = re.compile(r"(?i)(?<!\w)plus\s{1,2}(?=[0-9(])")
#: Wherever _AT or _DOT takes more than a plain mark this matches too, but for a bare "at", which needs such a dot.
_DISGUISE = re.compile(r"(?i)[\[({<]\s{0,2}(?:at|arroba|@|dot|punto|point|punkt|\.)\s{0,2}[\])}>]|\s(?:arroba|dot|punto|point|punkt)\s|\s@|@\s")
_LOOKS = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + INVISIBLE + "！-～\U0001d400-\U0001d7ff]")
_OUT = "doc_id long, spans array<struct<kind:string,start:int,end:int,disguised:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans by kind, leftmost and not overlapping within a kind."""
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= (n := len(m[0]) - m[0].count(" ") - m[0].count("-")) <= 19 and luhn(m[0].replace(" ", "").replace("-", "")):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


class Rewritten:
    """A text and, for each of its characters, the source range it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges, in order and apart; each new character stands for the whole range replaced."""
        if not edits:
            return
        parts, start, end, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            start += self.start[at:a]
            end += self.end[at:a]
            if b > a:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        parts.append(self.text[at:])
        self.text, self.start, self.end = "".join(parts), start + list(self.start[at:]), end + list(self.end[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    return HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Words of a run to digits; the gaps between its digits go, but not those that close it."""
    out, last = [], None
    for w in re.finditer(rf"(?i)(?<!\w)(?:{_WORDS})(?!\w)|[0-9]", m[0]):
        if last is not None and w.start() > last:
            out.append((m.start() + last, m.start() + w.start(), ""))
        if not w[0].isdigit():
            out.append((m.start() + w.start(), m.start() + w.end(), SPELLED[w[0].translate(_FOLD).lower()]))
        last = w.end()
    return out


def rewrite(text: str, spelled: bool = True) -> Rewritten | None:
    """The text without disguises, spelled digits only where asked for, or None if it has none."""
    out = Rewritten(text)
    if not text.isascii() and _LOOKS.search(text):
        out.replace([(m.start(), m.end(), _plain(m[0])) for m in _LOOKS.finditer(text)])
    if spelled and _ONE.search(out.text):
        out.replace([e for m in _SPELL.finditer(out.text) if _ONE.search(m[0]) for e in _spelled(m)])
    if "plus" in out.text.translate(_FOLD).lower():
        out.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
    if _DISGUISE.search(out.text):
        edits, floor = [], 0
        for m in _AT.finditer(out.text):
            if m.start() < max(floor, 1) or out.text[m.start() - 1] not in _LOCAL:
                continue
            host = _HOST.match(out.text, m.end())
            if host and (m[0].strip().lower() != "at" or _DISGUISE.search(host[0])):
                edits.append((m.start(), m.end(), "@"))
                edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(out.text, host.start(), host.end()) if d[0] != "."]
                floor = host.end()
        out.replace(edits)
        out.replace([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(out.text) if m[0] != "."])
    return out if out.text != text else None


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) by kind as listed, then start."""
    base = detect(text)
    out = {k: [(a, b, False) for a, b in base[k]] for k in KINDS}
    # a number word next to an identifier must not become part of it, so the text is read without spelled digits first
    plain = rewrite(text, False)
    full = rewrite(text) if _ONE.search(plain.text if plain else text) else None
    for clear in (plain, full if full and not (plain and full.text == plain.text) else None):
        for k, spans in (detect(clear.text) if clear else {}).items():
            for a, b in spans:
                s, e = clear.source(a, b)
                i = bisect_left(out[k], (e,))  # the spans so far are sorted and apart: only the one before e can touch
                if not (i and out[k][i - 1][1] > s):
                    out[k].insert(i, (s, e, True))
    return [(k, *span) for k in KINDS for span in sorted(out[k])]


def _run(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))
    for b in batches:
        made = [[dict(zip(("kind", "start", "end", "disguised"), s, strict=True)) for s in find_spans(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, kind)], names=["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id and spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run, _OUT)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_query(spark, sf_dir) -> DataFrame:
    found = find(shared.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["disguised"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def brute_base(text: str) -> str:
    """For tests: the base spans by the plain patterns, as the digest of their list."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in out).encode()).hexdigest()
