"""Substring removal by Rabin-Karp hashes of every fixed-length token window.

One exchange carries the window hashes, 8 bytes a window and packed by hash range, and a bit a window
comes back; chunks are ranges of doc_id of about equal bytes, so the first chunk that holds a hash holds its
first start. A chunk sends at most one row a bucket and never an empty one, so rows never outnumber windows.
Windows are judged on the input; overlapping repeated windows merge into maximal removal intervals.

Defined cases: null or empty text has no words and yields the hash of the empty string; a text shorter
than the window loses nothing; null doc_id sorts last; rows that repeat an id, or have none, are ordered by a
digest of their text, and equal rows are repeats of the first; other columns of the input are ignored.
Hashes have 64 bits over XXH64 word values: n windows give about n*n/2**65 chance matches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shared

#: Odd base of the rolling hash (a fixed value, any odd 64-bit number does).
BASE = 0x9E3779B97F4A7C15
_EMIT = "bucket int, chunk int, hashes binary"
_MASK = "chunk int, bucket int, bits binary, n long"
_OUT = "doc_id long, n_words long, n_removed long, kept_text string, intervals array<struct<start:int,end:int>>"


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each window of width word hashes, modulo 2**64, finished by a mix."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= np.uint64(BASE)
        h += words[j : j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _rows(tab):
    """(doc_id, words) of a chunk in order: ids ascending, null last, then digest and text."""
    ids, digests, texts = tab.column("doc_id").to_pylist(), tab.column("digest").to_pylist(), shared.text_bytes(tab.column("text"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, digests[i], texts[i]))
    return [(ids[i], texts[i].split()) for i in order]


def _windows(tab, width: int):
    known = shared.WordHashes()
    rows = _rows(tab)
    parts = [rolling(shared.word_hashes(w, known), width) for _, w in rows]
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return rows, parts, *np.unique(flat, return_index=True, return_inverse=True)


def _emitter(width: int, n_buckets: int):
    def emit(key, tab):
        import pyarrow as pa

        _, _, uniq, _, _ = _windows(tab, width)
        edge = shared.bucket_edges(uniq, n_buckets)
        full = np.flatnonzero(np.diff(edge))
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "hashes": pa.array([uniq[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary()),
        })

    return emit


def _reduce(key, tab):
    """Mark, for each chunk's hashes of this bucket, those that a smaller chunk has too."""
    import pyarrow as pa

    tab = tab.sort_by("chunk")
    runs = [np.frombuffer(b, np.uint64) for b in tab.column("hashes").to_pylist()]
    flat = np.concatenate(runs)
    order = np.argsort(flat, kind="stable")
    later = np.zeros(len(flat), bool)
    later[order[1:]] = flat[order[1:]] == flat[order[:-1]]
    ends = np.cumsum([len(r) for r in runs])[:-1]
    return pa.table({
        "chunk": tab.column("chunk"),
        "bucket": tab.column("bucket"),
        "bits": pa.array([np.packbits(m).tobytes() for m in np.split(later, ends)], pa.binary()),
        "n": pa.array([len(r) for r in runs], pa.int64()),
    })


def _applier(width: int):
    def apply(key, tab, masks):
        import pyarrow as pa

        rows, parts, uniq, first, inverse = _windows(tab, width)
        masks = masks.sort_by("bucket")
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(masks.column("bits").to_pylist(), masks.column("n").to_pylist(), strict=True)]
        later = np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)
        repeat = later[inverse] | (first[inverse] != np.arange(len(inverse)))
        out, at = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": [], "intervals": []}, 0
        for (doc_id, words), part in zip(rows, parts, strict=True):
            hit = np.flatnonzero(repeat[at : at + len(part)])
            at += len(part)
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + width, -1)
            gone = np.cumsum(step)[:-1] > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(hit) else words
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_text"].append(b" ".join(kept).decode("utf-8", "replace"))
            out["intervals"].append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.table({
            "doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
            "kept_text": pa.array(out["kept_text"], pa.string()), "intervals": pa.array(out["intervals"], pa.list_(kind)),
        })

    return apply


def remove_repeats(docs: DataFrame, width: int = 20, chunk_bytes: int = shared.CHUNK_BYTES) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_removed, kept_text and the removed word intervals."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunked, n = shared.ordered_chunks(docs.withColumn("digest", F.xxhash64("text")), chunk_bytes)
    n = max(n, shared.shuffle_parts(spark))
    # as many partitions as chunks: what a task reads does not grow with the input
    chunked = chunked.repartition(n, "chunk")
    sent = chunked.groupBy("chunk").applyInArrow(_emitter(width, n), _EMIT)
    masks = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(_reduce, _MASK)
    return chunked.groupBy("chunk").cogroup(masks.repartition(n, "chunk").groupBy("chunk")).applyInArrow(_applier(width), _OUT)


def op6_query(spark, sf_dir) -> DataFrame:
    out = remove_repeats(shared.table(spark, sf_dir, "documents"), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), p AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM w
), v AS (
  SELECT doc_id, pos, list(word) OVER f AS win, count(*) OVER f AS n FROM p
  WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), s AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(array_to_string(win, ' ')) ORDER BY doc_id, pos) > 1 AS again FROM v WHERE n = 20
), g AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM s WHERE again
), k AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.pos) AS kept
  FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.pos = p.pos) GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


def brute_force(rows: list[tuple], width: int) -> dict:
    """For tests: rows (doc_id, text) to doc_id -> (n_words, n_removed, sha256 of the kept words)."""
    seen, out = set(), {}
    digest = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64) if t is not None else 42
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1]))):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.setdefault(doc_id, []).append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
