"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are compared with numpy exclusive-or and bit counts in tiles sorted by population
count; tile pairs whose counts differ beyond the radius are skipped. So that work does not grow with the
square of the input, fingerprints are first dealt to tiles by the pieces of bits that any two within the
radius must share (of p pieces at least p - radius agree), which loses no link. A dealt group larger than
a tile is split by population count and salt, and each pair of its tiles that can link is one task group.
Tiles return spanning links, never all pairs; components run on those links in Spark.

Defined cases: null or empty text has fingerprint zero and links like any other; fewer words than a
shingle form one shingle of the whole sequence; rows that repeat an id keep a row each; null doc_id is
kept and never names a component unless all its members lack ids; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shared
from quillspark.llm.components import connected_components

TILE = 4096
_BITS = "doc_id long, digest long, fp long"
_LINK = "a long, b long"


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = np.array([fingerprint(t, width) for t in shared.text_bytes(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(made.view(np.int64))], names=["doc_id", "digest", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text) to doc_id, a digest of the text and the fingerprint as a signed long."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest")).mapInArrow(_fingerprints(width), _BITS)


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union in place: each label becomes the smallest index of its set."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def tile_links(group: np.ndarray, fp: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints of each group; group is sorted, fp unsigned."""
    n = len(fp)
    labels = np.arange(n)
    cuts = np.flatnonzero(np.diff(group)) + 1
    starts = np.concatenate([[0], cuts]) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    small = np.repeat(sizes <= 32, sizes)
    for d in range(1, min(32, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        if not len(i):
            continue
        near = np.bitwise_count(fp[i] ^ fp[i + d]) <= radius
        _merge(labels, i[near], i[near] + d)
    for s, size in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        count = np.bitwise_count(fp[s : s + size])
        order = s + np.argsort(count, kind="stable")
        counts = np.sort(count, kind="stable").astype(np.int64)
        for i in range(0, size, tile):
            top = counts[min(i + tile, size) - 1]
            for j in range(i, size, tile):
                if counts[j] - top > radius:
                    break
                x, y = order[i : i + tile], order[j : j + tile]
                p, q = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[y][None, :]) <= radius)
                _merge(labels, x[p], y[q])
    moved = np.flatnonzero((labels != np.arange(n)) & (fp != fp[labels]))
    return fp[moved], fp[labels[moved]]


def _linker(radius: int, at_least: int = 200_000):
    def run(batches):
        import pyarrow as pa

        def flush(g, f):
            a, b = tile_links(g, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        parts_g, parts_f, held = [], [], 0
        for b in batches:
            parts_g.append(b.column("g").to_numpy(zero_copy_only=False))
            parts_f.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            held += b.num_rows
            if held >= at_least:
                g, f = np.concatenate(parts_g), np.concatenate(parts_f)
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
                if cut:
                    yield flush(g[:cut], f[:cut])
                parts_g, parts_f, held = [g[cut:]], [f[cut:]], len(g) - cut
        if held:
            yield flush(np.concatenate(parts_g), np.concatenate(parts_f))

    return run


def _masks(pieces: int, radius: int) -> list[int]:
    edges = [64 * i // pieces for i in range(pieces + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(part[i] for i in chosen)) for chosen in combinations(range(pieces), pieces - radius)]


def near_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (column fp) to spanning links (a, b) of those within radius bits."""
    spark = fps.sparkSession
    n = fps.count()
    pieces = radius + 1 + (n >= 1 << 25) + (n >= 1 << 33)  # more pieces share longer keys as the input grows
    masks = _masks(pieces, radius)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))).alias("k")).select("fp", F.xxhash64("k.t", "k.key").alias("k"))
    big = keyed.groupBy("k").count().where(F.col("count") > tile).select("k", F.ceil(F.col("count") / tile).alias("salts"))
    dealt = keyed.join(big, "k", "left")
    own = F.struct(F.bit_count("fp").alias("p"), F.pmod(F.xxhash64("fp"), F.col("salts")).alias("s"))
    near = F.sequence(F.greatest(F.bit_count("fp") - radius, F.lit(0)), F.least(F.bit_count("fp") + radius, F.lit(64)))
    others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1), lambda s: F.struct(p.alias("p"), s.alias("s")))))
    pair = F.transform(others, lambda o: F.xxhash64("k", F.least(own, o), F.greatest(own, o)))
    dealt = dealt.select("fp", F.explode(F.when(F.col("salts").isNull(), F.array("k")).otherwise(pair)).alias("g"))
    parts = max(shared.shuffle_parts(spark), n // 500_000)
    return dealt.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_linker(radius), _LINK)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """docs(doc_id, text) to doc_id, digest, fp, component_id (smallest doc_id reachable) and root, a row per input row.

    root is a fingerprint that names the component; component_id does not where ids repeat or are null."""
    made = shared.written(fingerprints(docs, width), "simhash")
    fps = shared.written(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(near_links(fps.select("fp"), radius))
    member = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("first").alias("component_id"))
    label = member.join(named, "root").select("fp", "component_id", "root")
    return made.join(label, "fp").select("doc_id", "digest", "fp", "component_id", "root")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row of docs per group: of the least doc_id (nulls last), and of several rows with that id the one of least text digest.

    Rows equal in id and text are one; of those the one whose columns have the least digest stays, so reruns agree."""
    groups = near_duplicates(docs, width, radius).where("doc_id <=> component_id")
    # rows of one text share a root, so no two roots name the same id and digest
    first = groups.groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("digest").alias("_digest"))
    names = [f"`{c}`" for c in docs.columns]
    kept = docs.withColumn("_text_digest", F.xxhash64(F.col("text").cast("string")))
    kept = kept.join(first, kept.doc_id.cast("long").eqNullSafe(first._id) & (kept._text_digest == first._digest), "left_semi")
    one = kept.groupBy(F.col("doc_id").alias("_i"), "_text_digest").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_row"))
    return one.select("_row.*")


def op9_query(spark, sf_dir) -> DataFrame:
    out = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
