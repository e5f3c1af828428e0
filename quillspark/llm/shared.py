"""Helpers that several corpus operators use: sizing, chunking, word hashing and written intermediates.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.tables import spread
from quillspark.scratch import checkpointed, shared_folder

#: Text bytes that one chunk or hash bucket of a packed exchange should stand for.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one of fewer splits than cores is dealt out to all of them (see tables.spread)."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, set as the session's checkpoint folder too; raises on a cluster that names none."""
    shared = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    return checkpointed(df, what)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(spark: SparkSession, n_bytes: int, per: int = CHUNK_BYTES) -> int:
    """Chunks grow with the input, so that each stays of one size; never fewer than shuffle partitions."""
    return max(shuffle_parts(spark), math.ceil(n_bytes / per), 1)


def ordered_chunks(docs: DataFrame, per: int = CHUNK_BYTES, most_ranges: int = 2000) -> tuple[DataFrame, int]:
    """docs(doc_id, text, digest) with a column ``chunk`` that never decreases as (doc_id nulls last, digest)
    grows, and the number of chunks.

    Quantiles of the ids cut ranges whose text bytes are summed; their number is bounded, so what the driver
    holds is. Small ranges share a chunk; a large one is cut evenly by id, and one that is a single id, or no
    id, evenly by digest, so that chunks stand for about ``per`` bytes each."""
    from pyspark.ml.feature import Bucketizer

    quantiles = docs.approxQuantile("doc_id", [i / most_ranges for i in range(most_ranges + 1)], 1 / (4 * most_ranges)) or [0.0]
    often = {a for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b}
    cuts = sorted({*quantiles, *often, *(x + 1 for x in often)})
    none = len(cuts) + 1  # range 0 is below the first cut, i from the i-th cut on, and the last holds null ids
    placed = docs.withColumn("_id", F.col("doc_id").cast("double"))
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_at", handleInvalid="keep").transform(placed)
    placed = placed.withColumn("_at", F.when(F.col("_id").isNull(), none).otherwise(F.col("_at").cast("int")))
    sizes = {r[0]: r[1] for r in placed.groupBy("_at").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).collect()}  # at most 3 * most_ranges rows
    first, parts, now, held = [], [], 0, 0
    for at in range(none + 1):
        size = sizes.get(at) or 0
        if held and held + size > per:
            now, held = now + 1, 0
        first.append(now)
        parts.append(max(1, math.ceil(size / per)))
        held += size
        if parts[-1] > 1:
            now, held = now + parts[-1], 0
    pick = lambda values, kind: F.element_at(F.expr(f"cast(array({','.join(map(repr, values))}) as array<{kind}>)"), F.col("_at") + 1)
    low, high = pick([cuts[0], *cuts, 0.0], "double"), pick([cuts[0], *cuts[1:], cuts[-1], 0.0], "double")
    lone = pick([0, *(int(c in often) for c in cuts), 1], "int") == 1
    share = F.when(lone, F.col("digest") / F.lit(2.0**64) + 0.5).otherwise((F.col("_id") - low) / F.greatest(high - low, F.lit(1.0)))
    most = pick(parts, "int")
    part = F.least(F.greatest(F.floor(share * most), F.lit(0)), most - 1)
    return placed.withColumn("chunk", (pick(first, "int") + part).cast("int")).drop("_id", "_at"), first[-1] + parts[-1]


class WordHashes(dict):
    """Word bytes to XXH64; lives as long as one chunk, which bounds it."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def bucket_edges(sorted_hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; a bucket is a range of the hash's upper 32 bits."""
    at = ((sorted_hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(n_buckets + 1, dtype=np.uint64))


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null becomes empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()), b"").to_pylist()


def planes(a: np.ndarray) -> bytes:
    """An array as byte planes, high bytes of small numbers together, so that the shuffle's own codec packs them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
