"""Media columns: byte payloads as PNG images in binary columns, and cosine-transform hashes.

A payload becomes the samples of a greyscale 8-bit image WIDTH pixels wide.
The image is a PNG: signature, IHDR, the zlib stream cut into IDAT chunks,
IEND, each chunk with its CRC-32.  Each row gets the filter whose residues have
the least sum of absolute values.  The decoder tests every checksum, inflates,
and undoes the row filters with numpy along anti-diagonals: a sample needs its
left, upper and corner neighbours, so samples of equal column plus row are
undone together, those of all images of a batch at once.  The feature is the
sign pattern of the 8 x 8 lowest frequencies of a cosine transform of the image
brought to 32 x 32 samples, against their median.

Defined results: null text is empty; the empty text has a payload of WIDTH
zero bytes; equal texts have equal values; a damaged image raises ValueError;
repeated rows are stored apart; a very long text is one image, whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_dir, table, written

WIDTH = 64
#: Bytes of one IDAT chunk, the zlib level, and bytes of the images that are filtered or undone together.
CHUNK, LEVEL, GROUP = 1 << 16, 4, 1 << 20
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

STORED = "doc_id long, n_bytes long, media binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(body: bytes) -> bytes:
    """body and zero bytes up to a positive multiple of WIDTH."""
    return body + bytes(-len(body) % WIDTH if body else WIDTH)


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the one nearest to left + up - corner, the earlier of equals; all int16."""
    a, b = np.abs(up - corner), np.abs(left - corner)
    c = np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def _bordered(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All images under one another, a row of zeros above each and a column of zeros at the left; the place of each image's first row."""
    width = images[0].shape[1]
    size = np.array([len(x) for x in images])
    first = np.cumsum(size + 1) - size
    out = np.zeros((int(size.sum()) + len(images), width + 1), np.int16)
    for at, image in zip(first.tolist(), images, strict=True):
        out[at : at + len(image), 1:] = image
    return out, first


def filtered(images: list[np.ndarray], filters: np.ndarray | int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row filters, residues) of images of one width; filters: one for all rows, one for each row of all images, or the best of each row."""
    body, first = _bordered(images)
    size = [len(x) for x in images]
    rows = np.concatenate([np.arange(a, a + n) for a, n in zip(first.tolist(), size, strict=True)])
    x, left, up, corner = body[rows, 1:], body[rows, :-1], body[rows - 1, 1:], body[rows - 1, :-1]
    residues = np.stack([(x - guess).astype(np.uint8) for guess in (0, left, up, (left + up) >> 1, _paeth(left, up, corner))])
    if filters is None:
        kinds = np.abs(residues.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    else:
        kinds = np.broadcast_to(np.asarray(filters), len(rows))
    chosen = residues[kinds, np.arange(len(rows))]
    cuts = np.cumsum(size)[:-1]
    return list(zip(np.split(kinds.astype(np.uint8), cuts), np.split(chosen, cuts), strict=True))


def unfiltered(kinds: list[np.ndarray], bodies: list[np.ndarray]) -> list[np.ndarray]:
    """The samples of images of one width, from their row filters and residues."""
    width = bodies[0].shape[1]
    out, first = _bordered(bodies)
    size = np.array([len(x) for x in bodies])
    kind = np.concatenate(kinds).astype(np.int64)
    if kind.max(initial=0) > PAETH:
        raise ValueError(f"no such row filter: {kind.max()}")
    if kind.any():
        row = np.concatenate([np.arange(n) for n in size])
        at = (np.repeat(first, size) + row) * (width + 1) + 1
        # Rows by their number within the image: those that an anti-diagonal crosses lie side by side.
        order = np.argsort(row, kind="stable")
        row, at, kind = row[order], at[order], kind[order]
        begins = np.searchsorted(row, np.arange(int(size.max()) + 1))
        flat, shift = out.reshape(-1), at - row
        sub, above, mean, paeth = (kind == k for k in (SUB, UP, AVERAGE, PAETH))
        for t in range(int(size.max()) + width - 1):
            lo, hi = begins[max(0, t - width + 1)], begins[min(len(begins) - 1, t + 1)]
            i = shift[lo:hi] + t
            left, up, corner = flat[i - 1], flat[i - width - 1], flat[i - width - 2]
            guess = left * sub[lo:hi] + up * above[lo:hi] + ((left + up) >> 1) * mean[lo:hi] + _paeth(left, up, corner) * paeth[lo:hi]
            flat[i] = (flat[i] + guess) & 255
    return [out[a : a + n, 1:].astype(np.uint8) for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode(images: list[np.ndarray], filters: np.ndarray | int | None = None, level: int = LEVEL) -> list[bytes]:
    """Greyscale PNGs of uint8 arrays (rows, width) of one width."""
    out = []
    for kinds, body in filtered(images, filters):
        packer = zlib.compressobj(level, memLevel=9)
        stream = packer.compress(np.hstack((kinds[:, None], body)).tobytes()) + packer.flush()
        parts = [_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK)]
        out.append(SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", body.shape[1], len(body), 8, 0, 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b""))
    return out


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("PNG is cut off")
        n = int.from_bytes(png[at : at + 4], "big")
        kind, body, crc = png[at + 4 : at + 8], png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise ValueError(f"checksum of {kind!r} fails")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("PNG has no end")


def _inflated(png: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(row filters, residues) of a greyscale 8-bit PNG."""
    head, stream = b"", []
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            stream.append(body)
    width, rows, depth, colour, packing, filtering, lace = struct.unpack(">IIBBBBB", head)
    if (depth, colour, packing, filtering, lace) != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    if len(raw) != rows * (width + 1):
        raise ValueError("image has another size than its head says")
    raw = raw.reshape(rows, width + 1)
    return raw[:, 0], raw[:, 1:]


def decode(pngs: list[bytes]) -> list[np.ndarray]:
    """The samples (rows, width) of greyscale 8-bit PNGs of one width."""
    found = [_inflated(x) for x in pngs]
    return unfiltered([k for k, _ in found], [b for _, b in found]) if found else []


def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


_COS = _cosines()


def feature(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest frequencies lie above their median."""
    rows, width = pixels.shape
    edges = np.arange(32) * rows // 32
    total = np.vstack((np.zeros((1, width)), np.cumsum(pixels, axis=0, dtype=np.float64)))
    ends = np.maximum(edges + 1, np.append(edges[1:], rows))
    small = (total[ends] - total[edges]) / (ends - edges)[:, None]
    small = small.reshape(32, 32, width // 32).mean(axis=2)
    freq = np.round(_COS @ small @ _COS.T, 6).ravel()
    bits = freq > np.median(freq[1:])
    return np.packbits(bits).tobytes().hex()


def _groups(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of about GROUP bytes; a value is never split."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + GROUP, side="right")))
        yield lo, hi
        lo = hi


def store(docs: DataFrame) -> DataFrame:
    """STORED: each text's padded bytes as an image in a binary column."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _groups(batch.column(1)):
                bodies = [(x or "").encode() for x in batch.column(1)[lo:hi].to_pylist()]
                media = encode([np.frombuffer(pad(x), np.uint8).reshape(-1, WIDTH) for x in bodies])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([len(x) for x in bodies], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(step, STORED)


def features(stored: DataFrame) -> DataFrame:
    """RESULT: what the stored images hold, read back from their bytes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for lo, hi in _groups(batch.column(2)):
                rows: list[list] = [[] for _ in range(6)]
                pngs = batch.column(2)[lo:hi].to_pylist()
                for png, pixels in zip(pngs, decode(pngs), strict=True):
                    body = pixels.tobytes()
                    for column, x in zip(rows, (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(pixels)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(step, RESULT)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/media")
    return features(stored)
