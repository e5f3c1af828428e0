"""Bytes as greyscale PNG in binary columns, read back with checksum tests, and cosine-transform hashes.

The PNG writer uses one zlib stream in bounded IDAT chunks; the reader checks the signature and every
chunk's CRC-32, inflates, and undoes the five row filters in numpy. The feature is a 64-bit hash: the
image is averaged to 32 x 32, cosine-transformed, and the 8 x 8 lowest frequencies (without the constant
one) are compared with their median.

Defined cases: null text is empty; an empty payload is 64 zero bytes; equal texts give equal rows;
a stored image that fails a checksum or has a bad size raises ValueError; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shared

WIDTH = 64
#: PNG signature (fixed value of the format).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20
_STORED = "doc_id long, n_bytes long, media binary"
_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + b"\0" * (-len(raw) % unit if raw else unit)


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """8-bit greyscale rows of width samples, filter 2 (up) after the first row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = 2
    lines[0, 1:] = rows[0]
    lines[1:, 1:] = rows[1:] - rows[:-1]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo filters 0 to 4 of one-byte pixels; runs of rows with filter 2 are summed at once."""
    kinds, data = lines[:, 0], lines[:, 1:].copy()
    at, n = 0, len(data)
    while at < n:
        kind = kinds[at]
        if kind == 2:
            end = at + 1
            while end < n and kinds[end] == 2:
                end += 1
            if (kinds[at:end] == 2).all():
                if at:
                    data[at] += data[at - 1]
                data[at:end] = np.cumsum(data[at:end], axis=0, dtype=np.uint8)
            at = end
            continue
        up = data[at - 1] if at else np.zeros(data.shape[1], np.uint8)
        if kind == 1:
            data[at] = np.cumsum(data[at], dtype=np.uint8)
        elif kind in (3, 4):
            left = corner = 0
            row, above = data[at].tolist(), up.tolist()
            for i, x in enumerate(row):
                b = above[i]
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = left if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner
                row[i] = left = (x + guess) & 255
                corner = b
            data[at] = row
        elif kind:
            raise ValueError(f"row filter {kind}")
        at += 1
    return data


def decode_png(media: bytes) -> np.ndarray:
    """Rows of samples; ValueError if the signature, a CRC, the header or the size is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG without interlace")
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("image size")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def _cosines(n: int = 32, keep: int = 8) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def dct_hash(pixels: np.ndarray, side: int = 32) -> str:
    """16 hex digits: signs of the low frequencies against their median."""
    pixels = pixels.astype(np.float64)
    for axis in (0, 1):
        n = pixels.shape[axis]
        if n >= side:
            edge = np.arange(side) * n // side
            counts = np.diff(np.append(edge, n))
            pixels = np.add.reduceat(pixels, edge, axis=axis) / (counts[:, None] if axis == 0 else counts[None, :])
        else:
            pixels = np.take(pixels, np.arange(side) * n // side, axis=axis)
    c = _cosines(side)
    low = np.round(c @ pixels @ c.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def _store(batches):
    import pyarrow as pa

    for b in batches:
        raw = shared.text_bytes(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_png(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for media in b.column("media").to_pylist():
            pixels = decode_png(media)
            payload = pixels.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), dct_hash(pixels)))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", *names])


def store_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes and the PNG in a binary column ``media``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, _STORED)


def media_features(stored: DataFrame) -> DataFrame:
    """Read the media column back, test its checksums and derive digests and the cosine hash."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, _OUT)


def op5_query(spark, sf_dir) -> DataFrame:
    return media_features(store_media(shared.table(spark, sf_dir, "documents")))
