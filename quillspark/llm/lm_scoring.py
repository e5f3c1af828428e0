"""Language-model scores from a probabilistic suffix tree over words.

The root holds every training word. Deeper states are contexts of one to ``depth`` preceding words that occur
at least ``least`` times in training (a fixed number, so the tree grows with the corpus) and whose next-word
distribution diverges from that of their suffix: the Kullback-Leibler distance, less its sparse-sample bias
of half a unit per distinct follower, must reach ``epsilon``. A token is scored in the longest kept state that
is a suffix of what precedes it; each state is smoothed toward the next shorter kept one by its count of
distinct followers (Witten-Bell), ending in the root's (c + 0.1) / (N + 0.1 * (V + 1)).

No counts meet in one place. Documents are packed once into chunks of bounded text, written to the shared
folder. Level by level, each chunk sends its distinct (context, word) entries of frequent contexts to buckets
by context, where they are summed over all chunks and the contexts tested, and gets back the sums it asked
for; the sums of one level tell it which contexts of the next are frequent. A context of more than ``split``
occurrences is dealt over several buckets by follower; only of such contexts, at most 1 / SPLIT_SHARE of a
level, statistics reach the driver. A chunk sends at most one row a bucket and never an empty one, so rows
never outnumber entries.

Defined cases: null or empty text is the end token alone; null doc_id counts as empty text in the fold;
repeated rows get a row each; without training rows every token has probability 1; one text longer than a
chunk is a chunk of its own; other columns are ignored.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shared

FOLDS, DEPTH, MIN_COUNT, EPSILON = 10, 3, 500, 0.02
#: Occurrences of a context that one bucket takes; at least this share of all tokens, which bounds the split contexts.
SPLIT, SPLIT_SHARE = 1_000_000, 1e-5
#: Buckets or chunks that a task which writes takes one after the other, where there are enough for all cores.
TASK_PARTS = 4
#: Spark's setting by which a step's shuffle files go when the step ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The end token; white space, so no word equals it.
END = b"\n"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STATE = "chunk long, bytes long, doc_ids array<long>, train array<boolean>, sizes array<int>, words binary, codes binary"
_SENT = "bucket int, chunk long, e binary, k binary, p binary, c binary, cn binary, ct binary, cs binary"
_SUMS = "level int, chunk long, bucket int, counts binary, d binary, kept binary, stats array<struct<c:long,n:long,d:long,a:double,t:long>>"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, deep_tokens long"


class _Codes(dict):
    """Word bytes to their number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _pack(most: int):
    """Texts to chunks of about ``most`` bytes: hashes of the distinct words and a number per token."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def flush(seq):
            words = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            codes = np.concatenate(parts)
            columns = [[(part << 32) + seq], [held], [ids], [train], [[len(p) for p in parts]], [shared.planes(words)], [_thin(codes)]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "bytes", "doc_ids", "train", "sizes", "words", "codes"])

        part, seq, held, known, parts, ids, train = TaskContext.get().partitionId(), 0, 0, _Codes(), [], [], []
        end = known[END]
        for b in batches:
            for few in (b.slice(at, 500) for at in range(0, b.num_rows, 500)):  # texts become Python's a few at a time
                for i, t, raw in zip(few.column("doc_id").to_pylist(), few.column("train").to_pylist(), shared.text_bytes(few.column("text")), strict=True):
                    words = raw.lower().split()
                    made = np.full(len(words) + 1, end, np.uint32)
                    made[:-1] = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                    parts.append(made)
                    ids.append(i)
                    train.append(t)
                    held += len(raw)
                    if held >= most:
                        yield flush(seq)
                        seq, held, known, parts, ids, train = seq + 1, 0, _Codes(), [], [], []
                        end = known[END]
        if parts:
            yield flush(seq)

    return run


class Rules:
    """What every chunk and bucket must agree on."""

    def __init__(self, buckets: int, least: int, epsilon: float, depth: int, split: int):
        self.buckets, self.least, self.epsilon, self.depth, self.split = buckets, least, epsilon, depth, split
        self.n = self.v = 0
        #: Of each level the split contexts: sorted hashes, distinct followers, whether kept.
        self.states = []

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)

    def learn(self, stats: list) -> None:
        """Take the statistics of a level's split contexts; the root's are those of level 0."""
        if not self.states:
            self.n, self.v = (int(stats[0].n), int(stats[0].d)) if stats else (0, 0)
            self.split = max(self.split, math.ceil(self.n * SPLIT_SHARE))
        stats = sorted(stats, key=lambda r: r.c % (1 << 64))
        c, n, d, t = (np.array([r[i] for r in stats], np.int64) for i in (0, 1, 2, 4))
        self.states.append((c.view(np.uint64), d, self.keeps(n, d, np.array([r.a for r in stats], float), t)))

    def keeps(self, n, d, a, total) -> np.ndarray:
        """Whether the divergence of contexts reaches epsilon; a is the sum of k * log(k / parent's count)."""
        some = np.maximum(n, 1)
        return (n >= self.least) & ((a - some * np.log(some / np.maximum(total, 1)) - d / 2) / some >= self.epsilon)


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = context * _ODD + word
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _thin(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, only as many as the greatest needs; their number goes first."""
    wide = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return b"".join([bytes([wide]), *((a >> a.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(wide))])


def _thick(raws: list[bytes], kind=np.int64) -> np.ndarray:
    """The numbers of several such strings, joined."""
    out, at = np.zeros(sum((len(raw) - 1) // raw[0] for raw in raws), kind), 0
    for raw in raws:
        wide = raw[0]
        n = (len(raw) - 1) // wide
        for i in range(wide):
            out[at : at + n] |= np.frombuffer(raw, np.uint8, n, 1 + i * n).astype(kind) << kind(8 * i)
        at += n
    return out


def _news(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _ordered(high: np.ndarray, low: np.ndarray, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of numbers in order, packed into one each, and where each stood. Sorted together with its place
    where both fit 64 bits, which is several times faster than sorting places."""
    pair = high << low_bits
    pair |= low
    bits = len(pair).bit_length()
    if len(pair) and int(high.max()).bit_length() + low_bits + bits <= 63:
        pair <<= bits
        pair |= np.arange(len(pair))
        pair.sort()
        order = pair & ((1 << bits) - 1)
        pair >>= bits
        return pair, order
    order = np.argsort(pair, kind="stable")
    return pair[order], order


class Chunk:
    """The tokens of a chunk and, level by level, the entries that it sends and the sums that come back.

    Words are their places among the chunk's words by hash, and an entry is its place in sending order: by
    bucket, context and word. Whatever depends on an entry alone is computed once for it, not for each token."""

    def __init__(self, tab, rules: Rules):
        row = {name: tab.column(name)[0] for name in tab.column_names}
        self.rules, self.doc_ids, self.train = rules, row["doc_ids"], row["train"]
        self.sizes = np.array(row["sizes"].values, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        words = shared.unplanes(row["words"].as_py(), np.uint64)
        order = np.argsort(words, kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        self.words, self.tokens = words[order], place[_thick([row["codes"].as_py()], np.int32)]
        #: Of the last level: the entry of each token (-1: none) and the training count of each entry.
        self.entry = self.counts = None

    def entries(self, level: int) -> None:
        """The distinct entries of a level in sending order, from the counts of the level before."""
        r = self.rules
        if level == 0:
            self.at, self.entry, self.word = slice(None), self.tokens, np.arange(len(self.words), dtype=np.int32)
            bucket = r.bucket(self.words)
            new = _news(bucket)
            self.heads = np.flatnonzero(new)
            none = np.ones(len(self.heads), np.int64)
            self.bucket, self.context, self.occurs, self.total, self.split = bucket[self.heads], np.zeros(len(none), np.uint64), none, none, none > 0
            self.group, self.parent = np.cumsum(new, dtype=np.int32) - 1, np.ones(len(self.words), np.int64)
            return
        often = np.flatnonzero(self.counts >= r.least)
        occurs, context = self.counts[often], _mix(self.context[self.group[often]], self.words[self.word[often]])
        total = self.parent[often] if level > 1 else np.full(len(often), r.n, np.int64)
        # A slot is a context in a bucket; slots are numbered in sending order.
        slices = occurs // r.split + 1
        offset = np.cumsum(slices) - slices
        of = np.repeat(np.arange(len(often)), slices)
        bucket = r.bucket(_mix(context[of], (np.arange(len(of)) - offset[of]).astype(np.uint64)))
        order = np.lexsort((context[of], bucket))
        new = _news(bucket[order], context[of][order])
        slot = np.empty(len(of), np.int64)
        slot[order] = np.cumsum(new) - 1
        lead = order[new]
        # The slot of each token that follows a frequent context.
        number = np.full(len(self.counts) + 1, -1, np.int32)
        number[often] = np.arange(len(often))
        after = np.full(len(self.tokens), -1, np.int32)
        after[1:] = number[self.entry[:-1]]
        after[self.starts] = -1
        self.at = np.flatnonzero(after >= 0).astype(np.int32)
        after = after[self.at]
        part = offset[after]
        if len(of) > len(often):
            many = np.flatnonzero(slices[after] > 1)
            part[many] += (self.words[self.tokens[self.at[many]]] % slices[after[many]].astype(np.uint64)).astype(np.int64)
        low_bits = len(self.words).bit_length()
        part = slot[part]
        del after
        pair, order = _ordered(part, self.tokens[self.at], low_bits)
        del part
        new, order = _news(pair), self.at[order]
        #: Of each entry the one without its first word, a level below.
        self.suffix = self.entry[order[new]]
        self.entry = np.full(len(self.tokens), -1, np.int32)
        self.entry[order] = np.cumsum(new, dtype=np.int32) - 1
        self.parent = self.counts[self.suffix]
        pair = pair[new]
        self.word, slots = (pair & ((1 << low_bits) - 1)).astype(np.int32), pair >> low_bits
        new = _news(slots)
        self.group, self.heads = np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new)
        lead = lead[slots[self.heads]]
        self.bucket, self.context, self.occurs, self.total, self.split = bucket[lead], *(x[of[lead]] for x in (context, occurs, total, slices > 1))

    def sent(self, chunk: int):
        import pyarrow as pa

        k = np.bincount(self.entry[self.at], weights=np.repeat(np.array(self.train.as_py(), float), self.sizes)[self.at], minlength=len(self.word)).astype(np.int64)
        head_at = np.append(np.flatnonzero(_news(self.bucket)), len(self.heads))
        ends = np.append(self.heads, len(self.word))[head_at]
        full = self.bucket[head_at[:-1]]
        by = lambda x, at, pack=_thin: pa.array([pack(x[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
        sizes = np.diff(np.append(self.heads, len(self.word)))
        return pa.table({
            "bucket": pa.array(full.astype(np.int32)), "chunk": pa.array([chunk] * len(full), pa.int64()), "e": by(self.words[self.word], ends, shared.planes), "k": by(k, ends), "p": by(self.parent, ends),
            "c": by(self.context, head_at, shared.planes), "cn": by(sizes, head_at), "ct": by(self.total, head_at), "cs": by(self.split.astype(np.uint8), head_at),
        })

    def receive(self, sums) -> None:
        """Take the sums of a level's entries."""
        self.counts = _thick(sums.column("counts").to_pylist())

    def score(self, level: int, sums) -> None:
        """Take the tests of a level's states too; tokens move on to the longer state where it is kept."""
        r = self.rules
        if level == 0:
            self.chance, self.far = (self.counts + 0.1) / (r.n + 0.1 * (r.v + 1)), np.zeros(len(self.counts), bool)
            self.known, self.p, self.deep = (self.counts > 0)[self.tokens], np.log10(self.chance)[self.tokens], np.zeros(len(self.tokens), bool)
            self.base = np.add.reduceat(self.p, self.starts)
            return
        d, kept = (_thick(sums.column(name).to_pylist()) for name in ("d", "kept"))
        kept = kept > 0
        states, wide, wide_kept = r.states[level]
        if len(states):
            at = np.minimum(np.searchsorted(states, self.context), len(states) - 1)
            here = self.split & (states[at] == self.context)
            d, kept = np.where(here, wide[at], d), np.where(here, wide_kept[at], kept)
        on = kept[self.group]
        self.chance, self.far = self.chance[self.suffix], self.far[self.suffix] | on
        d = d[self.group][on]
        self.chance[on] = (self.counts[on] + d * self.chance[on]) / (self.occurs[self.group][on] + d)
        entry = self.entry[self.at]
        self.p[self.at], self.deep[self.at] = np.log10(self.chance)[entry], self.far[entry]

    def replay(self, sums, upto: int, score: bool = False) -> None:
        """Levels below ``upto`` from their sums."""
        import pyarrow.compute as pc

        for level in range(upto):
            self.entries(level)
            mine = sums.filter(pc.equal(sums.column("level"), level)).sort_by("bucket")
            self.receive(mine)
            if score:
                self.score(level, mine)


@contextmanager
def _freeing(spark):
    """What a step inside has shuffled goes from the disks at its end, not when the driver happens to collect its
    garbage. Only for frames that run once: what is returned to run later is made outside."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _first_sender(rules: Rules):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                c = Chunk(pa.Table.from_batches([b.slice(i, 1)]), rules)
                c.entries(0)
                yield from c.sent(b.column("chunk")[i].as_py()).to_batches()

    return run


def _sender(rules: Rules, level: int):
    def send(key, tab, sums):
        c = Chunk(tab, rules)
        c.replay(sums, level)
        c.entries(level)
        return c.sent(key[0].as_py())

    return send


def _adder(rules: Rules, level: int):
    def add(key, tab):
        """Sum a bucket's entries over all chunks and test its contexts; the split ones leave their part statistics."""
        import pyarrow as pa

        raw = {name: tab.column(name).to_pylist() for name in ("e", "k", "p", "c", "cn", "ct", "cs")}
        parts, heads = ([shared.unplanes(x, np.uint64) for x in raw[name]] for name in ("e", "c"))
        words, contexts, group = np.concatenate(parts), np.concatenate(heads), _thick(raw["cn"])
        states, place, of = np.unique(contexts, return_index=True, return_inverse=True)
        e, group = _mix(np.repeat(contexts, group), words), np.repeat(of, group)
        del words
        order = np.argsort(e)
        new = _news(e[order])
        first, inverse = order[new], np.empty(len(e), np.int32)
        inverse[order] = np.cumsum(new, dtype=np.int32) - 1
        del e, order, new
        total = np.bincount(inverse, weights=_thick(raw["k"]), minlength=len(first)).astype(np.int64)
        live = total > 0
        t, group = total[live].astype(float), group[first][live]
        sums = lambda w: np.bincount(group, weights=w, minlength=len(states))
        n, d, a = sums(t).astype(np.int64), sums(np.ones(len(t))).astype(np.int64), sums(t * np.log(t / _thick(raw["p"])[first][live]))
        above, split = (_thick(raw[name])[place] for name in ("ct", "cs"))
        kept = rules.keeps(n, d, a, above.astype(float)) & (split == 0)
        kind = pa.list_(pa.struct([("c", pa.int64()), ("n", pa.int64()), ("d", pa.int64()), ("a", pa.float64()), ("t", pa.int64())]))
        stats = [{"c": int(states[i].astype(np.int64)), "n": int(n[i]), "d": int(d[i]), "a": float(a[i]), "t": int(above[i])} for i in np.flatnonzero(split)]
        rows = tab.num_rows

        def reply(x, inverse, sizes):
            return pa.array([*(_thin(y) for y in np.split(x[inverse], np.cumsum(sizes)[:-1])), None], pa.binary())

        sizes, head_sizes = [len(x) for x in parts], [len(x) for x in heads]
        return pa.table({
            "level": pa.array([level] * (rows + 1), pa.int32()), "chunk": pa.array([*tab.column("chunk").to_pylist(), -1], pa.int64()), "bucket": pa.array([key[0].as_py()] * (rows + 1), pa.int32()),
            "counts": reply(total, inverse, sizes), "d": reply(d, of, head_sizes), "kept": reply(kept.astype(np.uint8), of, head_sizes),
            "stats": pa.array([*([None] * rows), stats], kind),
        })

    return add


def _scorer(rules: Rules):
    def score(key, tab, sums):
        import pyarrow as pa

        c = Chunk(tab, rules)
        c.replay(sums, rules.depth + 1, score=True)
        by_doc = lambda x: np.add.reduceat(x, c.starts)
        ids, train = c.doc_ids.values, c.train.values
        return pa.table({
            "doc_id": ids, "held_out": pa.array([not x for x in train.to_pylist()], pa.bool_()), "n_tokens": pa.array(c.sizes, pa.int64()),
            "n_known": pa.array(by_doc(c.known.astype(np.int64)), pa.int64()), "base_score": pa.array(c.base, pa.float64()),
            "score": pa.array(by_doc(c.p), pa.float64()), "deep_tokens": pa.array(by_doc(c.deep.astype(np.int64)), pa.int64()),
        })

    return score


def score(docs: DataFrame, folds: int = FOLDS, least: int = MIN_COUNT, epsilon: float = EPSILON, depth: int = DEPTH, chunk_bytes: int = shared.CHUNK_BYTES, split: int = SPLIT) -> DataFrame:
    """docs(doc_id, text) to a row each with counts, root score and tree score (log10), and train_tokens."""
    spark = docs.sparkSession
    rest = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (rest != 0).alias("train"))
    replies = []

    def few(df):
        """Partitions one after the other in fewer tasks: for each file written, Hadoop without its native library starts processes."""
        return df.coalesce(min(parts, max(2 * spark.sparkContext.defaultParallelism, parts // TASK_PARTS)))

    def answered():
        every = reduce(DataFrame.unionByName, replies).where("chunk >= 0").drop("stats")
        return state.repartition(parts, "chunk").groupBy("chunk").cogroup(every.repartition(parts, "chunk").groupBy("chunk"))

    with _freeing(spark):
        state = shared.written(docs.mapInArrow(_pack(chunk_bytes), _STATE), "lm-chunks")
        size = state.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        parts = shared.chunk_count(spark, size, chunk_bytes)
        rules = Rules(parts, least, epsilon, depth, split)
        for level in range(depth + 1):
            sent = answered().applyInArrow(_sender(rules, level), _SENT) if level else state.mapInArrow(_first_sender(rules), _SENT)
            replies.append(shared.written(few(sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_adder(rules, level), _SUMS)), f"lm-level{level}"))
            part = replies[-1].where("chunk = -1").select(F.explode("stats").alias("s"))
            stats = part.groupBy("s.c").agg(F.sum("s.n").alias("n"), F.sum("s.d").alias("d"), F.sum("s.a").alias("a"), F.max("s.t").alias("t"))
            rules.learn(stats.collect())  # the root, then at most 1 / SPLIT_SHARE split contexts of a level
    out = few(answered().applyInArrow(_scorer(rules), _OUT))
    return out.withColumn("train_tokens", F.lit(rules.n).cast("long"))


def op1_query(spark, sf_dir) -> DataFrame:
    return score(shared.table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple], folds: int = FOLDS, least: int = MIN_COUNT, epsilon: float = EPSILON, depth: int = DEPTH) -> dict:
    """For tests: rows (doc_id, text) to doc_id -> (n_tokens, n_known, N, base, score), by plain counting."""
    import zlib
    from collections import Counter, defaultdict

    toks = [(i, [*(w.decode() for w in (t or "").encode().lower().split()), "\n"], zlib.crc32(("" if i is None else str(i)).encode()) % folds != 0) for i, t in rows]
    follow = defaultdict(Counter)
    for _, ws, train in toks:
        for i, w in enumerate(ws):
            for j in range(min(i, depth) + 1 if train else 0):
                follow[tuple(ws[i - j : i])][w] += 1
    size = {s: sum(f.values()) for s, f in follow.items()}
    c, n = follow[()], size.get((), 0)

    def diverges(s):
        f, parent, of = follow[s], follow[s[1:]], size[s[1:]]
        return (sum(k * math.log((k / size[s]) / (parent[w] / of)) for w, k in f.items()) - len(f) / 2) / size[s] >= epsilon

    kept = {s for s in size if s and size[s] >= least and diverges(s)}
    out = {}
    for doc_id, ws, _ in toks:
        base = total = 0.0
        for i, w in enumerate(ws):
            p = (c[w] + 0.1) / (n + 0.1 * (len(c) + 1))
            base += math.log10(p)
            for j in range(1, min(i, depth) + 1):
                if (s := tuple(ws[i - j : i])) in kept:
                    p = (follow[s][w] + len(follow[s]) * p) / (size[s] + len(follow[s]))
            total += math.log10(p)
        out[doc_id] = (len(ws), sum(c[w] > 0 for w in ws), n, base, total)
    return out
