"""PNG media columns: chunks with checksum tests, zlib data, numpy unfiltering, cosine hashes.

A payload becomes an 8-bit grey image of 64 columns.  ``encode`` picks one of
three row filters by the smallest sum of magnitudes; ``decode`` reads any 8-bit grey
non-interlaced PNG (all five filters) and tests every checksum.  The perceptual hash keeps the 8 x 8
lowest frequencies of a 32 x 32 area-averaged image, compared with their median.

Defined results: null and empty texts give one row of zero bytes; damaged files raise MediaError in
``decode`` and give null columns in ``read_media``; rows that repeat a doc_id are stored separately.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import as_bytes, map_rows, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Data chunks are cut here, so that readers can test a long image piece by piece.
CHUNK = 1 << 16


class MediaError(ValueError):
    pass


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A PNG of ``payload``, whose length is a positive multiple of ``width``."""
    img = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = img.copy(), img.copy()
    sub[:, 1:] -= img[:, :-1]
    up[1:] -= img[:-1]
    choices = np.stack([img, sub, up])
    kind = np.minimum(choices, -choices).sum(2, dtype=np.int64).argmin(0)
    rows = np.empty((len(img), width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = choices[kind, np.arange(len(img))]
    packed = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(img), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)) + chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, data) of every chunk, checksums tested."""
    if png[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise MediaError("cut off")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(png) < at + 12 + size or zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise MediaError(f"bad checksum in {kind!r}")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise MediaError("no end")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters; runs of rows with one filter go together where the filter allows it."""
    out = rows.copy()
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        kind = kinds[a]
        before = out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            out[a:b] = np.cumsum(rows[a:b], 1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(rows[a:b], 0, dtype=np.uint8) + before
        elif kind in (3, 4):
            for r in range(a, b):
                out[r] = previous_based(kind, rows[r], before)
                before = out[r]
        elif kind:
            raise MediaError(f"unknown filter {kind}")
    return out


def previous_based(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average and Paeth rows, which depend on the pixel before."""
    done, left, corner = [], 0, 0
    for x, up in zip(row.tolist(), above.tolist(), strict=True):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(p - v))
        left, corner = (x + guess) & 255, up
        done.append(left)
    return np.array(done, np.uint8)


def decode(png: bytes) -> np.ndarray:
    """The image, rows by columns."""
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not 8-bit grey without interlace")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != head[1] * (head[0] + 1):
        raise MediaError("wrong size")
    raw = raw.reshape(head[1], head[0] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


SIDE, LOW = 32, 8
COSINES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def averaged(img: np.ndarray, axis: int) -> np.ndarray:
    """Bins of nearly equal width along an axis; short axes repeat lines."""
    n = img.shape[axis]
    edges = np.arange(SIDE + 1) * n // SIDE
    if n < SIDE:
        return np.take(img, np.minimum(edges[:-1], n - 1), axis)
    sums, sizes = np.add.reduceat(img, edges[:-1], axis), np.diff(edges)
    return sums / (sizes[:, None] if axis == 0 else sizes)


def cosine_hash(img: np.ndarray) -> bytes:
    """64 bits: which low frequencies exceed their median (the mean brightness is left out of it)."""
    low = COSINES @ averaged(averaged(img.astype(np.float64), 0), 1) @ COSINES.T
    low = np.round(low, 6)
    return np.packbits(low > np.median(low.ravel()[1:])).tobytes()


def padded(text: bytes, unit: int = WIDTH) -> bytes:
    return text + b"\0" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the PNG of every text as a binary column."""

    def make():
        return lambda doc_id, text: (doc_id, len(text), encode(padded(text)))

    return map_rows(docs.select("doc_id", as_bytes("text")), make, "doc_id long, n_bytes long, media binary", step=64)


def read_media(media: DataFrame, digests: bool = True) -> DataFrame:
    """Decode a table of (doc_id, n_bytes, media): payload or its digests, and the hash as a binary column."""

    def make():
        def one(doc_id, n_bytes, png):
            try:
                img = decode(png or b"")
            except MediaError:
                return doc_id, n_bytes, None, None, None, len(png or b""), hashlib.sha256(png or b"").hexdigest(), None, None
            payload, mark = img.tobytes(), cosine_hash(img)
            body = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) if digests else (payload.hex(), zlib.crc32(payload[-64:]))
            return doc_id, n_bytes, len(payload), *body, len(png), hashlib.sha256(png).hexdigest(), mark.hex(), mark

        return one

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, cosine_hash binary"
    return map_rows(media.select("doc_id", "n_bytes", "media"), make, schema, step=64)


def op7_media_png(spark, sf_dir: str) -> DataFrame:
    return read_media(write_media(table(spark, sf_dir, "documents")))
