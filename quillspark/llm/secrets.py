r"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Both models are first-order over a fixed alphabet, trained from labelled samples by DataFrame aggregates;
only the table of log-likelihood ratios, one number per pair of letters, reaches the driver. A run of
secret-like characters whose mean ratio exceeds the threshold is a span of kind ``markov``; of another run,
each stretch whose ratios sum to more than the evidence asked for is one, widened to the marks / _ = around
it, so that a secret is found beside ordinary text. All of it runs in Spark's own functions.

Defined cases: null text is empty and has no spans; spans count code points; base spans
always stay, and what they leave of a run is scored as a run of its own; repeated rows give repeated results; other columns are kept
by redact() and ignored by scan().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import let
from quillspark.llm import shared

#: The base patterns; group 2 of assign has 12 characters or more, the others are complete here.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
CANDIDATE = r"[A-Za-z0-9+/_=]{16,}"
#: Mean log-likelihood ratio per pair above which a run counts as random.
THRESHOLD = 0.5
#: Sum of log-likelihood ratios above which a stretch within a run counts as random.
EVIDENCE = 9.0
SEPARATORS = "/_="
#: Ordinary words from which labelled identifiers are built.
PLAIN = (
    "account address archive backup before block build call category channel child client code column commit complete container control count "
    "current database default depth device directory domain dynamic element encode error execute factory field final folder forward gateway global handler "
    "height host index input instance internal iterator last length license link load logger machine manager mask maximum menu metadata minimum "
    "mode monitor multiple network normal object operation origin package parallel parse path pending pipeline policy post previous print "
    "product progress protocol public random read reference register remove replace require response return root rule schedule second select serial "
    "session signal size socket source split standard static step stream style summary symbol target terminal thread title topic track transform type "
    "update user variable view warning widget word action available between boolean browser character collection compare connection content copyright create description digit document exception "
    "expected extension feature filename function group header history identifier ignore implementation import information integer interface json language library local location message method module "
    "multipart number option optional order parameter password permission position prefix priority property python query queue result sequence server service simple string structure system table template test timeout token unicode unknown value version write xml"
)
_SPAN = "array<struct<start:int,end:int,kind:string>>"
_FOLD = "struct<at:int,part:int,start:int,sum:double,best:double,end:int,out:array<struct<start:int,end:int>>>"


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """text, random (boolean): n rows of each label, made by digests from a counter, so the size is fixed.

    Random strings are base64 with and without marks, hexadecimal, upper-case and lower-case alphanumeric;
    ordinary ones are snake case, camel case, capital constants, paths, assignments, plain words in a row,
    names with numbers, dates and rules of one mark. Every letter is one of ALPHABET."""
    rows = spark.range(n).select("id", F.sha2(F.concat(F.lit("sample"), F.col("id")).cast("binary"), 256).alias("h"))
    coded = F.base64(F.unhex("h"))
    upper = F.translate(F.upper(F.substring(coded, 1, 32)), "+/=", "QXZ")
    noises = [F.substring(coded, 1, 40), F.translate(F.substring(coded, 1, 40), "+/=", "aZ7"), F.translate(F.substring(coded, 4, 36), "+/=", "Kq4"), F.substring("h", 1, 40), upper, F.lower(upper)]
    number = lambda i: F.conv(F.substring("h", i * 8 + 1, 7), 16, 10).cast("long")
    words = F.array(*map(F.lit, PLAIN.split()))
    w = [F.element_at(words, (F.pmod(number(i), F.lit(len(PLAIN.split()))) + 1).cast("int")) for i in range(4)]
    some = lambda i, m: F.pmod(number(i), F.lit(m)).cast("string")
    camel = lambda *x: F.concat(*(F.initcap(y) for y in x))
    date = F.concat_ws("/", F.concat(F.lit("20"), F.lpad(some(4, 40), 2, "0")), F.lpad(some(5, 12), 2, "0"), F.lpad(some(6, 31), 2, "0"), F.lpad(some(7, 24), 2, "0"))
    plains = [
        F.concat_ws("_", *w[:3]), F.concat(w[0], camel(*w[1:])), F.upper(F.concat_ws("_", *w[:3])), F.concat_ws("/", *w), F.concat(*w[:3]), F.concat_ws("_", w[0], w[1], some(2, 97)), camel(*w[:3]),
        F.concat(w[0], F.lit("="), w[1], F.lit("/"), w[2]), F.concat(F.upper(F.substring(w[0], 1, 3)), camel(w[1], w[2]), some(3, 10)), date, F.repeat(F.substring(F.lit("_=/+"), (F.pmod(number(0), F.lit(4)) + 1).cast("int"), F.lit(1)), 20), F.concat(some(0, 10**9), some(1, 10**9), some(2, 10**9)),
    ]
    of = lambda kinds: F.element_at(F.array(*kinds), F.pmod("id", F.lit(len(kinds))).cast("int") + 1)
    return rows.select(of(noises).alias("text"), F.lit(True).alias("random")).unionByName(rows.select(of(plains).alias("text"), F.lit(False).alias("random")))


def train_ratios(samples: DataFrame, smooth: float = 2.0) -> list[float]:
    """Log-likelihood ratios of letter pairs, row-major over ALPHABET; pairs are counted in Spark."""
    k = len(ALPHABET)
    letters = F.filter(F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda i: i >= 0)
    seen = samples.select("random", letters.alias("x")).where(F.size("x") > 1)
    pairs = seen.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.element_at("x", i) * k + F.element_at("x", i + 1))).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 * 66 * 66 rows
    totals = {(label, a): sum(counts.get((label, a * k + b), 0) for b in range(k)) for label in (True, False) for a in range(k)}
    log_p = lambda label, a, b: math.log((counts.get((label, a * k + b), 0) + smooth) / (totals[label, a] + smooth * k))
    return [round(log_p(True, a, b) - log_p(False, a, b), 4) for a in range(k) for b in range(k)]


def _located(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches: the gaps between matches and the matches give the offsets."""
    gap, hit = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind")))).alias("out"))

    zipped = F.zip_with(F.slice(gap, 1, F.size(hit)), hit, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base patterns by kind; an assignment whose value is short is dropped, not retried."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    all_ = _located(text, ASSIGN, "assign")
    kept = F.transform(F.filter(F.zip_with(all_, value, lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: F.length(x["v"]) >= 12), lambda x: x["s"])
    return {"assign": F.when(F.size(all_) > 0, kept).otherwise(all_), "access": _located(text, ACCESS, "access"), "hex": _located(text, HEX, "hex")}


def markov_score(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per pair of letters of a string over ALPHABET."""
    k = len(ALPHABET)
    table, letters = F.array(*map(F.lit, ratios)), F.lit(ALPHABET)
    code = F.transform(F.split(text, ""), lambda c: F.instr(letters, c) - 1)
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.element_at(table, acc["last"] * k + c + 1))).alias("sum"))
    total = F.aggregate(F.filter(code, lambda c: c >= 0), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])
    return total / F.greatest(F.length(text) - 1, F.lit(1))


def stretches(text: Column, ratios: list[float], evidence: float = EVIDENCE) -> Column:
    """Ranges (start, end) of a string over ALPHABET whose ratios sum to more than evidence, by one running sum.

    A stretch ends where its sum falls to zero or by evidence below its best, and is widened to whole parts
    between separators; ranges that then overlap are joined."""
    k = len(ALPHABET)
    table, letters, marks = F.array(*map(F.lit, ratios)), F.lit(ALPHABET), F.array(*(F.lit(ALPHABET.index(c)) for c in SEPARATORS))
    codes = F.transform(F.split(text, ""), lambda c: F.instr(letters, c) - 1)
    pairs = let(codes, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: F.struct(F.array_contains(marks, b).alias("mark"), F.element_at(table, a * k + b + 1).alias("r"))))
    state = lambda at, part, start, sum_, best, end, out: F.struct(at.alias("at"), part.alias("part"), start.alias("start"), sum_.alias("sum"), best.alias("best"), end.alias("end"), out.alias("out")).cast(_FOLD)
    closed = lambda acc: F.when(acc["best"] > evidence, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])

    def step(acc, x):
        total = acc["sum"] + x["r"]
        part = F.when(x["mark"], acc["at"] + 1).otherwise(acc["part"])
        over, better = (total <= 0) | (total < acc["best"] - evidence), total > acc["best"]
        return F.when(over, state(acc["at"] + 1, part, part, F.lit(0.0), F.lit(0.0), F.lit(0), closed(acc))).otherwise(
            state(acc["at"] + 1, part, acc["start"], total, F.greatest(total, acc["best"]), F.when(better, acc["at"] + F.when(x["mark"], 0).otherwise(1)).otherwise(acc["end"]), acc["out"])
        )

    first = F.when(F.substring(text, 1, 1).isin(*SEPARATORS), 1).otherwise(0)
    start = state(F.lit(1), first, first, F.lit(0.0), F.lit(0.0), F.lit(0), F.array().cast("array<struct<start:int,end:int>>"))
    found = F.aggregate(pairs, start, step, closed)
    # a regular expression from the end of a stretch takes the rest of its part
    rest = lambda s: F.length(F.regexp_extract(F.substring(text, s["end"] + 1, F.length(text)), f"^[^{SEPARATORS}]*", 0))
    wide = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (s["end"] + rest(s)).cast("int").alias("end")))

    def join(acc, s):
        last = F.element_at(acc, -1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(wide, F.array().cast("array<struct<start:int,end:int>>"), join)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with as many blanks in place of each span; spans are sorted by start and may overlap."""

    def cut(acc, s):
        at, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, at - acc["at"]), F.repeat(F.lit(" "), end - at))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    left = F.aggregate(spans, start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, left).otherwise(text)


def scan(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with columns assign, access, hex, markov: arrays of (start, end, kind), end exclusive."""
    ratios = ratios or train_ratios(labelled_samples(docs.sparkSession))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumns({f"_{k}": v for k, v in base_spans(text).items()})
    base = F.array_sort(F.transform(F.concat("_assign", "_access", "_hex"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    found = found.withColumn("_left", _blanked(text, base))
    found = found.withColumn("_runs", _located(F.col("_left"), CANDIDATE, "markov"))
    whole = lambda run: F.array(F.struct(F.lit(0).alias("start"), F.length(run).alias("end")))
    random = lambda run: F.when(markov_score(run, ratios) > threshold, whole(run)).otherwise(stretches(run, ratios))
    within = lambda s: let(F.substring("_left", s["start"] + 1, s["end"] - s["start"]), random)
    placed = lambda s: F.transform(within(s), lambda x: F.struct((s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end"), F.lit("markov").alias("kind")))
    return found.withColumn("_markov", F.flatten(F.transform("_runs", placed)).cast(_SPAN)).drop("_runs", "_left")


def _listed(spans: Column, by_start: bool) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")) if by_start else F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float] | None = None, mark: str = "<SECRET>") -> DataFrame:
    """docs with every span of text replaced by mark; n_chars, if there, follows. Clean rows are unchanged."""
    columns = docs.columns
    found = scan(docs, ratios)
    spans = F.array_sort(F.transform(F.concat("_assign", "_access", "_hex", "_markov"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def cut(acc, s):
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def op4_query(spark, sf_dir) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs).select("doc_id", "_assign", "_access", "_hex", "_markov")
    base = F.concat("_assign", "_access", "_hex")
    return found.select(
        "doc_id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(base, True), 256).alias("base_sha256"),
        _listed(F.concat(base, F.col("_markov")), True).alias("spans"),
    )
