"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, and neighbouring placeholders one slot, so a template is
never mostly slots and an occurrence lines up with its item whatever the fillers' lengths. Windows of five
template tokens of every document are hash-joined with those of the benchmark, next to windows of the plain
lower-case words. Within one occurrence the fillers must be consistent: one benchmark filler stands for one
document filler. An item is found in a document if 0.8 or more of its windows are, in the better of both
views; for templates those of one occurrence (two tokens of play), for plain words those of the document.

Nothing of the benchmark passes through the driver but a bit table of fixed size (``BITS``) over its window
hashes. Documents are read once: what passes the table is kept by document, joined with each item's rarest
windows (as many as an item that is found cannot miss all of), and the pairs that this yields are checked in
full. A larger benchmark or a fuller table costs time, never results.

Defined cases: null or empty text holds no item; an item shorter than a window is one window, all its tokens in
a row (so a one-word item is found wherever the word is); templates need two ordinary words; an item without
letters or digits is found nowhere; equal items are found together; rows that repeat an id give a row each in
find(); filter_clean() keeps all columns and null ids, and rows equal in id and text share their fate.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shared
from quillspark.llm.substring_dedup import BASE, rolling

WIDTH, COVER, PLAY = 5, 0.8, 2
#: Size of the bit table over the benchmark's window hashes; 4 MB, whatever the benchmark.
BITS = 1 << 25
#: Words that count as numbers or units (fixed values).
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons s ms sec second seconds min minute minutes h hr hour hours day days week weeks month months year years l ml liter liters litre litres gallon gallons cup cups usd eur gbp dollar dollars cent cents euro euros percent degree degrees c f k v w j n pa hz kwh mph kmh".split())
#: Words that are ordinary though a sentence begins with them in capitals (fixed values).
STARTERS = frozenset(
    "a an the this that these those it its he she they we you i in on at by for from to of and or but if when while what which who whom whose where why how is are was were do does did can could will would there after before each every "
    "all some find compute calculate given suppose let solve der die das ein eine wenn was wer wie wo le la les un une si que qui quel quelle comment el los las una cuando como cual".split()
)
#: Marks that are words of their own where they stand alone (fixed values).
OPERATORS = frozenset("+ = × ÷".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,:/]*)([A-Za-z]{1,4})")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_ITEMS = "key long, ph array<long>, th array<long>, tf array<long>"
_HITS = "doc_id long, digest long, ph array<long>, th array<long>, tj array<int>, tf array<long>"
_FOUND = "doc_id long, digest long, copies long, key long, coverage double, exact boolean"
#: Kinds of slots; 0 is an ordinary word.
NAME, NUMBER, UNIT, MEASURE = 1, 2, 3, 4


def canonical(word: str) -> tuple[str, int]:
    """A word to (plain token, kind of slot or 0); ("", 0) if it is marks only."""
    if word in OPERATORS:
        return word, 0
    bare = word.lstrip("!\"#%&'()*,./:;<=>?@[\\]^_`{|}~").rstrip("!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~")
    if not bare.isalnum():
        bare = _EDGE.sub("", bare)
        if not any(map(str.isalnum, bare)):
            return "", 0
    plain = bare.lower()
    if plain in NUMBERS:
        return plain, NUMBER
    if plain in UNITS and len(plain) > 1:
        return plain, UNIT
    if bare.isalpha():
        return plain, NAME if bare.istitle() and len(bare) > 1 and plain not in STARTERS else 0
    if _NUMBER.fullmatch(bare):
        return plain, NUMBER
    if (m := _NUMBER_UNIT.fullmatch(bare)) and m[2].lower() in UNITS:
        return plain, MEASURE
    return plain, NAME if len(bare) > 1 and bare[0].isupper() and bare[1:].islower() else 0


class _Words(dict):
    """Word bytes to a row of the lists below, which the caller clears when they are large."""

    def __init__(self):
        self.hash, self.kind, self.real = [], [], []

    def __missing__(self, word: bytes) -> int:
        plain, kind = canonical(word.decode("utf-8", "replace"))
        self.hash.append(xxhash.xxh64_intdigest(plain.encode()))
        self.kind.append(kind)
        self.real.append(bool(plain))
        value = self[word] = len(self.real) - 1
        return value

    def reset(self) -> None:
        self.clear()
        self.__init__()


def _runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values, in order."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = np.diff(np.append(starts, len(values)))
    power = np.cumprod(np.full(int(sizes.max()), BASE, np.uint64))
    return np.add.reduceat(values * power[np.arange(len(values)) - np.repeat(starts, sizes)], starts)


class _View:
    """Tokens of some texts in a row, marks left out: plain words, and templates whose slots are merged."""

    def __init__(self, raws: list[bytes], words: _Words):
        parts = [np.fromiter(map(words.__getitem__, w), np.int64, len(w)) for w in map(bytes.split, raws)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        real = np.array(words.real, bool)[ids]
        ids, self.owner = ids[real], owner[real]
        self.plain, kind = np.array(words.hash, np.uint64)[ids], np.array(words.kind, np.uint64)[ids]
        more = np.zeros(len(ids), bool)
        more[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & (self.owner[1:] == self.owner[:-1])
        starts = np.flatnonzero(~more)
        self.slot, self.t_owner = kind[starts] > 0, self.owner[starts]
        filler = _runs(self.plain, starts)
        turn = ~more
        turn[1:] |= kind[1:] != kind[:-1]  # of kinds that repeat within a slot only the first counts
        first = np.cumsum(turn) - 1
        self.template = np.where(self.slot, _runs(kind[turn], first[starts]), self.plain[starts])
        self.filler = np.where(self.slot, filler | np.uint64(1), np.uint64(0))

    def windows(self, template: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that stay within a text and where they begin."""
        tokens, owner = (self.template, self.t_owner) if template else (self.plain, self.owner)
        made = rolling(tokens, width)
        at = np.flatnonzero(owner[: len(made)] == owner[width - 1 :]) if len(made) else np.empty(0, np.int64)
        if template and len(at):
            words = np.cumsum(np.append(0, ~self.slot))
            at = at[words[at + width] - words[at] >= 2]
        return made[at] ^ np.uint64(2 * width + template), at

    def fillers(self, at: np.ndarray, width: int) -> np.ndarray:
        """WIDTH numbers a window: the fillers of its slots, 0 for ordinary words."""
        out = np.zeros((len(at), WIDTH), np.uint64)
        for d in range(width):
            out[:, d] = self.filler[at + d]
        return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _describe(batches):
    """Benchmark texts to their windows in both views."""
    import pyarrow as pa

    words = _Words()
    for b in batches:
        out = []
        for raw in shared.text_bytes(b.column("text")):
            view = _View([raw], words)
            ph, _ = view.windows(False, min(WIDTH, max(1, len(view.plain))))
            width = min(WIDTH, max(1, len(view.template)))
            th, at = view.windows(True, width)
            out.append((_signed(ph), _signed(th), _signed(view.fillers(at, width)).ravel()))
            if len(words) > 300_000:
                words.reset()
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([o[i] for o in out], kind) for i in range(3))], names=["key", "ph", "th", "tf"])


class _Table:
    """A bit table of fixed size with two probes a hash; what it lets through by chance is checked later."""

    def __init__(self, rows: list):
        self.bits = np.zeros(BITS >> 6, np.uint64)
        for word, value in rows:
            self.bits[word] = value % (1 << 64)

    @staticmethod
    def places(h):
        return [F.pmod(h, F.lit(BITS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(BITS))]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = np.arange(len(hashes))
        for shift in (0, 32):
            place = (hashes[at] >> np.uint64(shift)) & np.uint64(BITS - 1)
            at = at[(self.bits[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0]
        return at


def _collect_hits(table: _Table, widths: tuple[list[int], list[int]], step: int = 4 << 20):
    """Documents to their windows that the table knows, about step bytes of text at a time."""

    def hits(raws, words):
        view = _View(raws, words)
        plain, template = defaultdict(list), defaultdict(list)
        for width in widths[0]:
            h, at = view.windows(False, width)
            on = table.has(h)
            for i, x in zip(view.owner[at[on]].tolist(), _signed(h[on]).tolist(), strict=True):
                plain[i].append(x)
        for width in widths[1]:
            h, at = view.windows(True, width)
            on = table.has(h)
            first = np.searchsorted(view.t_owner, np.arange(len(raws)))
            for i, j, x, f in zip(view.t_owner[at[on]].tolist(), at[on].tolist(), _signed(h[on]).tolist(), _signed(view.fillers(at[on], width)).tolist(), strict=True):
                template[i].append((j - int(first[i]), x, f))
        for i in sorted(plain.keys() | template.keys()):
            t = template.get(i, [])
            yield i, sorted(set(plain.get(i, []))), [x for _, x, _ in t], [j for j, _, _ in t], [y for _, _, f in t for y in f]

    def run(batches):
        import pyarrow as pa

        words, kind = _Words(), pa.list_(pa.int64())
        for b in batches:
            raws, out, at = shared.text_bytes(b.column("text")), [], 0
            while at < len(raws):
                end, size = at, 0
                while end < len(raws) and size < step:
                    size += len(raws[end])
                    end += 1
                out += [(at + i, *found) for i, *found in hits(raws[at:end], words)]
                if len(words) > 300_000:
                    words.reset()
                at = end
            rows = pa.array([o[0] for o in out], pa.int64())
            lists = [pa.array([o[i] for o in out], k) for i, k in ((1, kind), (2, kind), (3, pa.list_(pa.int32())), (4, kind))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("digest").take(rows), *lists], names=["doc_id", "digest", "ph", "th", "tj", "tf"])

    return run


def template_coverage(item_h: list[int], item_f: list[int], doc_h: list[int], doc_j: list[int], doc_f: list[int]) -> float:
    """The largest share of an item's template windows that one occurrence holds with consistent fillers."""
    n, places, best = len(item_h), defaultdict(list), 0
    for i, h in enumerate(item_h):
        places[h].append(i)
    pairs = sorted((j - i, i, at) for at, (h, j) in enumerate(zip(doc_h, doc_j, strict=True)) for i in places.get(h, ()))
    shifts = np.array([p[0] for p in pairs], np.int64)
    for start in np.unique(shifts).tolist():
        near = pairs[np.searchsorted(shifts, start) : np.searchsorted(shifts, start + PLAY, "right")]
        if len({i for _, i, _ in near}) < COVER * n - 1e-9:
            continue
        near.sort(key=lambda p: (p[0] + p[1], p[1]))  # of fillers equally often the first in the document counts
        fillers = defaultdict(Counter)
        slots = [[(item_f[WIDTH * i + d], doc_f[WIDTH * at + d]) for d in range(WIDTH) if item_f[WIDTH * i + d]] for _, i, at in near]
        for filled in slots:
            for a, b in filled:
                fillers[a][b] += 1
        chosen = {a: max(c, key=c.get) for a, c in fillers.items()}
        best = max(best, len({i for (_, i, _), filled in zip(near, slots, strict=True) if all(chosen[a] == b for a, b in filled)}))
    return best / n if n else 0.0


def _check(batches):
    """Pairs of a document's and an item's windows to the item's coverage; those below the threshold go."""
    import pyarrow as pa

    for b in batches:
        rows, out = {c: b.column(c).to_pylist() for c in ("ph", "th", "tj", "tf", "item_ph", "item_th", "item_tf")}, []
        for r, (ph, th, tj, tf, iph, ith, itf) in enumerate(zip(*rows.values(), strict=True)):
            held = set(ph)
            share = sum(h in held for h in iph) / len(iph) if iph else 0.0
            cover = share if share == 1 or not ith else max(share, template_coverage(ith, itf, th, tj, tf))
            if cover >= COVER:
                out.append((r, cover, share == 1))
        at = pa.array([o[0] for o in out], pa.int64())
        columns = [b.column(c).take(at) for c in ("doc_id", "digest", "copies", "key")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())], names=["doc_id", "digest", "copies", "key", "coverage", "exact"])


def _items(benchmark: DataFrame) -> DataFrame:
    """A row per distinct text with its windows."""
    texts = benchmark.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("key", F.xxhash64("text"))
    return shared.written(texts.dropDuplicates(["key"]).select("key", "text").mapInArrow(_describe, _ITEMS), "leak-items")


def _signatures(items: DataFrame) -> DataFrame:
    """(h, key): of each item and view the rarest windows, so many that an item that is found has one of them."""
    views = [items.select("key", F.lit(c).alias("view"), F.explode(c).alias("h")) for c in ("ph", "th")]
    every = views[0].unionByName(views[1])
    ranked = every.join(every.groupBy("h").agg(F.count(F.lit(1)).alias("often")), "h")
    lists = ranked.groupBy("key", "view").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("x"))
    enough = F.size("x") - F.ceil(F.size("x") * COVER - 1e-9) + 1
    return lists.select("key", F.explode(F.slice("x", F.lit(1), enough.cast("int"))).alias("s")).select(F.col("s.h").alias("h"), "key").distinct()


def _decide(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text, digest) to a row per pair of an (id, text) and an item's text in it, with the number of copies."""
    items = _items(benchmark)
    every = items.select(F.explode(F.concat("ph", "th")).alias("h"))
    places = every.select(F.explode(F.array(*_Table.places(F.col("h")))).alias("p"))
    bits = places.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    table = _Table([tuple(r) for r in bits.collect()])  # at most BITS / 64 rows
    sizes = items.select(F.size("ph").alias("p"), F.size("th").alias("t"))
    widths = _widths(benchmark) if sizes.where("p = 1 or t = 1").limit(1).count() else ([WIDTH], [WIDTH])
    hits = docs.mapInArrow(_collect_hits(table, widths), _HITS).where("size(ph) + size(th) > 0")
    # equal rows are one, counted before the exchange
    lists = ["ph", "th", "tj", "tf"]
    hits = shared.written(hits.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in lists)), "leak-hits")
    found = hits.select("doc_id", "digest", F.explode(F.array_distinct(F.concat("ph", "th"))).alias("h")).join(_signatures(items), "h")
    pairs = found.select("doc_id", "digest", "key").distinct().withColumnsRenamed({"doc_id": "_i", "digest": "_d"})
    pairs = pairs.join(items.withColumnsRenamed({c: f"item_{c}" for c in ("ph", "th", "tf")}), "key")
    pairs = pairs.join(hits, F.col("_i").eqNullSafe(F.col("doc_id")) & (F.col("_d") == F.col("digest")))
    return pairs.select("doc_id", "digest", "copies", "key", *lists, "item_ph", "item_th", "item_tf").mapInArrow(_check, _FOUND)


def _widths(benchmark: DataFrame) -> tuple[list[int], list[int]]:
    """The window widths that the benchmark has in each view; fewer than WIDTH only for short items."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            words, out = _Words(), set()
            for raw in shared.text_bytes(b.column("text")):
                if len(words) > 300_000:
                    words.reset()
                view = _View([raw], words)
                out |= {(0, min(WIDTH, max(1, len(view.plain)))), (1, min(WIDTH, max(1, len(view.template))))}
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int32()) for i in (0, 1)], names=["view", "width"])

    seen = {(r.view, r.width) for r in benchmark.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "view int, width int").distinct().collect()}
    return tuple(sorted({w for v, w in seen if v == view} | {WIDTH}) for view in (0, 1))  # at most 2 * WIDTH rows


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, coverage, exact) of every item found in a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    found = _decide(docs, benchmark).join(ids, "key")
    return found.select("doc_id", "item_id", "coverage", "exact", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_c")).drop("_c")


def filter_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, all columns kept."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    # written, so that its size is known before the join and the documents are shuffled only where it is large
    found = shared.written(_decide(keyed, benchmark).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "leak-documents")
    same = docs.doc_id.cast("long").eqNullSafe(found._id) & (F.xxhash64(docs.text.cast("string")) == found._digest)
    return docs.join(found, same, "left_anti")


def op3_query(spark, sf_dir) -> DataFrame:
    return find(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def brute_force(text: str | None, item: str | None) -> float:
    """For tests: the coverage of an item in a document by comparing every window as words, without hashes."""

    def read(t):
        plain, merged = [], []
        for w in (t or "").encode().split():
            p, kind = canonical(w.decode())
            if not p:
                continue
            plain.append(p)
            if kind and merged and merged[-1][0] != "word":
                merged[-1] = (merged[-1][0] if merged[-1][0][-1] == kind else (*merged[-1][0], kind), (*merged[-1][1], p))
            else:
                merged.append(((kind,), (p,)) if kind else ("word", p))
        return plain, merged

    (ip, it), (dp, dt) = read(item), read(text)
    if not ip:
        return 0.0
    w = min(WIDTH, len(ip))
    have = {tuple(dp[j : j + w]) for j in range(len(dp) - w + 1)}
    best = sum(tuple(ip[i : i + w]) in have for i in range(len(ip) - w + 1)) / (len(ip) - w + 1)
    w = min(WIDTH, len(it))
    token = lambda x: x if x[0] == "word" else x[0]
    cut = lambda x: [(i, [token(y) for y in x[i : i + w]]) for i in range(len(x) - w + 1) if sum(y[0] == "word" for y in x[i : i + w]) >= 2]
    wanted, got = cut(it), cut(dt)
    pairs = [(j - i, n, i, j) for n, (i, a) in enumerate(wanted) for j, b in got if a == b]
    for start in {p[0] for p in pairs}:
        near = sorted((p for p in pairs if start <= p[0] <= start + PLAY), key=lambda p: (p[3], p[2]))
        votes = defaultdict(Counter)
        slots = {p: [(it[p[2] + d][1], dt[p[3] + d][1]) for d in range(w) if it[p[2] + d][0] != "word"] for p in near}
        for p in near:
            for a, b in slots[p]:
                votes[a][b] += 1
        fits = {p[1] for p in near if all(max(votes[a], key=votes[a].get) == b for a, b in slots[p])}
        best = max(best, len(fits) / len(wanted))
    return best
