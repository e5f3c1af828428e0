"""Text distances and scores. Short texts use Spark's own levenshtein; long ones a bit-parallel Arrow function."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from quillspark.functions import text as X

#: Up to this length the quadratic built-in is the faster one.
SHORT = 512


def _letter_bits(a) -> dict:
    """For each distinct element the bit vector of its places."""
    places: dict = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    out = {}
    for c, at in places.items():
        row = bytearray((len(a) >> 3) + 1)
        for i in at:
            row[i >> 3] |= 1 << (i & 7)
        out[c] = int.from_bytes(row, "little")
    return out


def _banded(a, b, where: dict, most: int) -> int | None:
    """Edit distance of a (the longer) and b if it is at most ``most``, from the band of cells that it can use."""
    n, m = len(a), len(b)
    width = 2 * most + 2
    full, corner = (1 << width) - 1, 1 << (width - 1)
    plus, minus, score, edge, start = full ^ ((1 << (width - most - 1)) - 1), 0, most, corner >> 1, most + 1 - width
    give_up, turn = 2 * most + m - n, n - most
    get = where.get
    for j in range(m):
        bits = get(b[j], 0)
        if bits:
            bits = (bits >> start if start >= 0 else bits << -start) & full
        d0 = ((((bits & plus) + plus) ^ plus) | bits | minus) & full
        up, down = minus | ((d0 | plus) ^ full), d0 & plus
        if j < turn:
            if not d0 & corner:
                score += 1
        else:
            if up & edge:
                score += 1
            elif down & edge:
                score -= 1
            edge >>= 1
        if score > give_up:
            return None
        d0 >>= 1
        plus, minus = down | ((d0 | up) ^ full), d0 & up
        start += 1
    return score if score <= most else None


def bit_distance(a, b) -> int:
    """Edit distance of two sequences: bit vectors (Myers, Hyyro) in a band that widens until it holds the answer.

    Where the shorter one is the longer one with elements left out, one pass gives it: the difference in length."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    rest = iter(long)
    if all(c in rest for c in short):
        return len(long) - len(short)
    n = min(len(a), len(b))
    start = 0
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    where = _letter_bits(a)
    most = max(64, (len(a) - len(b)) * 5 // 4 + 32)
    while most < len(a) // 3:
        found = _banded(a, b, where, most)
        if found is not None:
            return found
        most *= 4
    full = (1 << len(a)) - 1
    plus, minus = full, 0
    for c in b:
        match = where.get(c, 0)
        d0 = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up, down = minus | ((d0 | plus) ^ full), plus & d0
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | ((d0 | up) ^ full), up & d0
    return len(b) + plus.bit_count() - minus.bit_count()


def _each_pair(a: pa.Array, b: pa.Array, measure, kind: pa.DataType) -> pa.Array:
    """measure of each pair; no more than one pair at a time becomes Python strings."""
    pairs = ((x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True))
    return pa.array((None if x is None or y is None else measure(x, y) for x, y in pairs), kind, size=len(a))


@F.arrow_udf(IntegerType())
def _long_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each_pair(a, b, bit_distance, pa.int32())


@F.arrow_udf(IntegerType())
def word_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance over words; exact for any number of distinct words."""
    return _each_pair(a, b, lambda x, y: bit_distance(x.split(), y.split()), pa.int32())


def _line_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return difflib.SequenceMatcher(None, a.split("\n") if a else [], b.split("\n") if b else []).ratio()


@F.arrow_udf(DoubleType())
def line_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the matching lines over all lines, by longest matching blocks."""
    return _each_pair(a, b, _line_similarity, pa.float64())


def edit_distance(a: Column, b: Column, any_length: bool = True) -> Column:
    """Edit distance in characters; any_length adds the Arrow path for texts of which both are long."""
    if not any_length:
        return F.levenshtein(a, b)
    long = F.least(F.length(a), F.length(b)) > SHORT
    return F.when(long, _long_distance(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(F.when(~long, a), F.when(~long, b)))


def _rate(distance: Column, ref_size: Column, hyp_size: Column) -> Column:
    return F.when(ref_size == 0, F.when(hyp_size > 0, 1.0).otherwise(0.0)).otherwise(distance / ref_size)


def cer(ref: Column, hyp: Column, any_length: bool = True) -> Column:
    """Character error rate of texts as given; an empty reference costs 1 unless both are empty."""
    return _rate(edit_distance(ref, hyp, any_length), F.length(ref), F.length(hyp))


def word_list(x: Column) -> Column:
    return F.filter(F.split(x, rf"{X.SPACE}+"), lambda w: w != "")


def word_codes(ref: Column, hyp: Column) -> tuple[Column, Column]:
    """Both texts with each distinct word as one character, for the built-in; up to 20,992 distinct words."""
    a, b = word_list(ref), word_list(hyp)
    known = F.array_distinct(F.concat(a, b))
    code = lambda w: F.decode(F.unhex(F.hex(F.lit(19967) + F.array_position(known, w))), "UTF-16BE")
    return F.array_join(F.transform(a, code), ""), F.array_join(F.transform(b, code), "")


def wer(ref: Column, hyp: Column, any_length: bool = True) -> Column:
    """Word error rate; any_length uses the Arrow function, else words are coded for the built-in."""
    n, m = F.size(word_list(ref)), F.size(word_list(hyp))
    if any_length:
        return _rate(word_distance(ref, hyp), n, m)
    a, b = word_codes(ref, hyp)
    return _rate(F.levenshtein(a, b), n, m)


def demo_wer(ref: Column, hyp: Column) -> Column:
    """Characters between the space-joined words over the number of words; may exceed 1."""
    n = F.size(word_list(ref))
    return _rate(edit_distance(F.array_join(word_list(ref), " "), F.array_join(word_list(hyp), " ")), n, F.size(word_list(hyp)))


def _target_lines(x: Column) -> Column:
    return F.filter(F.transform(X.split_lines(x), X.strip), lambda s: s != "")


def _prediction_lines(x: Column, target: Column) -> Column:
    return F.slice(F.filter(_target_lines(x), lambda s: ~s.startswith("#")), 1, F.size(target))


def edit_similarity(target: Column, prediction: Column, any_length: bool = True) -> Column:
    """0 to 100 over stripped lines; comments leave the prediction, which is cut to the target's lines."""
    want = _target_lines(target)
    a, b = F.array_join(want, "\n"), F.array_join(_prediction_lines(prediction, want), "\n")
    if not any_length:
        return X.let(F.struct(a.alias("a"), b.alias("b")), lambda p: _similarity(p["a"], p["b"], F.levenshtein(p["a"], p["b"])))
    return _similarity(a, b, edit_distance(a, b))


def _similarity(a: Column, b: Column, distance: Column) -> Column:
    both, one = (a == "") & (b == ""), (a == "") | (b == "")
    return F.when(both, 100.0).when(one, 0.0).otherwise((1 - distance / F.greatest(F.length(a), F.length(b))) * 100)


def exact_match(target: Column, prediction: Column) -> Column:
    want = _target_lines(target)
    return F.when(want == _prediction_lines(prediction, want), 100.0).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    part = lambda p: X.let(F.sqrt(dot(p["a"], p["a"]) * dot(p["b"], p["b"])), lambda size: F.when(size > 0, dot(p["a"], p["b"]) / size).otherwise(0.0))
    return X.let(F.struct(a.alias("a"), b.alias("b")), part)


def option_probability(log_a: Column, log_b: Column) -> tuple[Column, Column]:
    """Two log probabilities to a softmax; a missing option is 2.3 below the other."""
    a, b = F.coalesce(log_a, log_b - 2.3), F.coalesce(log_b, log_a - 2.3)
    total = F.exp(a) + F.exp(b)
    return F.exp(a) / total, F.exp(b) / total


def swapped_preference(b_first: Column, a_second: Column) -> Column:
    """Mean of a judge's preference for the same answer in both orders."""
    return (b_first + a_second) / 2


def text_preference(first: Column, second: Column) -> Column:
    """B in the first order and A in the second score 1 each; no answer at all is one half."""
    score = (F.coalesce((F.upper(first) == "B").cast("int"), F.lit(0)) + F.coalesce((F.upper(second) == "A").cast("int"), F.lit(0))) / 2
    return F.when(first.isNull() & second.isNull(), 0.5).otherwise(score)


def is_correct(predicted: Column, answer: Column) -> Column:
    return F.coalesce(predicted == F.upper(answer), F.lit(False))


def code_bleu(ref: Column, hyp: Column, scorer=None) -> Column:
    """A scorer's result (an Arrow function of both texts), -1 where there is none or it gives null."""
    return F.lit(-1.0) if scorer is None else F.coalesce(scorer(ref, hyp), F.lit(-1.0))
