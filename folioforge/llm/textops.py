"""Vectorised word cutting and window hashing over Arrow string columns.

Texts are handled as UTF-8 bytes, many documents at a time, in chunks of
bounded size.  A word class is a set of bytes; bytes of 0x80 and above count
as word bytes, so a class of code points that holds everything outside ASCII
can be tested byte by byte.

The plain hash of a word is a polynomial over the ring of 64-bit integers whose
terms come from a random table, followed by a bijective mixer.  It is quick and
good for finding candidates; words can be made that collide, so it proves
nothing.  What an operator takes for identity without looking at the words again
are keyed (`strong`) hashes of words, or BLAKE2b digests of runs of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=8)
def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(1234 + seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the longest table of a base is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        terms = np.full(size, base, dtype=np.uint64)
        terms[0] = 1
        have = np.multiply.accumulate(terms)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def word_table(separators: bytes | None = None, keep: bytes | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(byte is in a word, byte after lower-casing A-Z).

    separators: the bytes outside words; keep: the ASCII bytes inside words.
    """
    inside = np.ones(256, dtype=bool)
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    if separators is not None:
        inside[list(separators)] = False
    if keep is not None:
        inside[:128] = False
        inside[list(keep)] = True
        if lower:
            inside[65:91] = inside[97:123]
    return inside, fold


WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
BLANK_WORDS = word_table(separators=WHITE)
BLANK_WORDS_LOWER = word_table(separators=WHITE, lower=True)
ALNUM_WORDS_LOWER = word_table(keep=b"0123456789abcdefghijklmnopqrstuvwxyz", lower=True)


@dataclass
class Words:
    """Words of a chunk: byte spans, the first word of each document, hashes."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    hashes: tuple[np.ndarray, ...]
    inside: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 joined by one space."""
        raw = self.buf
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist(), strict=True))


def joined(words: Words) -> np.ndarray:
    """The words' bytes, one blank after each."""
    inside = words.inside
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    flat = words.buf[keep]
    flat[~inside[keep]] = 32
    # No byte parts the last word of a document from the first of the next, nor ends the last.
    touching = words.ends[np.concatenate((words.starts[1:] == words.ends[:-1], [len(words.ends) > 0 and words.ends[-1] == len(words.buf)]))] if len(words.ends) else words.ends
    return np.insert(flat, np.cumsum(keep)[touching - 1], 32) if len(touching) else flat


def places(words: Words) -> np.ndarray:
    """First byte of each word in `joined`, and the end of all."""
    return np.concatenate(([0], np.cumsum(words.ends - words.starts + 1)))


def strong(words: Words, key: int, seeds: int = 1) -> Words:
    """The same words with hashes keyed by a number of 63 bits that is drawn for each run, so no text can be made to collide.

    Words of up to 15 bytes are, with their length, two lanes of 64 bits, which three
    rounds of a Feistel network turn over: two seeds together tell any two such words
    apart.  Longer ones are hashed by BLAKE2b.
    """
    size = words.ends - words.starts
    bytes_ = np.zeros(len(words.buf) + 16, np.uint8)
    bytes_[: len(words.buf)] = words.buf
    view = np.ndarray((len(words.buf) + 9,), np.dtype("<u8"), bytes_, 0, (1,))
    full, low = np.minimum(size, 8).astype(np.uint64), np.clip(size - 8, 0, 7).astype(np.uint64)
    a = view[words.starts] & ~U64(0) >> (U64(64) - (full << U64(3)))
    b = view[np.minimum(words.starts + 8, len(words.buf))] & (U64(1) << (low << U64(3))) - U64(1) | size.astype(np.uint64) << U64(56)
    k1, k2, k3 = (U64(int.from_bytes(blake2b(bytes([i]), digest_size=8, key=key.to_bytes(8)).digest())) for i in range(3))
    b = b ^ mix(a + k1)
    a = a ^ mix(b + k2)
    if seeds > 1:
        b ^= mix(a + k3)
    lanes = (a, b)[:seeds]
    long = np.flatnonzero(size > 15)
    if len(long):
        whole, secret = words.buf.tobytes(), key.to_bytes(8)
        raw = b"".join([blake2b(whole[s:e], digest_size=16, key=secret).digest() for s, e in zip(words.starts[long].tolist(), words.ends[long].tolist(), strict=True)])
        for lane, digest in zip(lanes, np.frombuffer(raw, np.uint64).reshape(-1, 2).T, strict=False):
            lane[long] = digest
    return replace(words, hashes=lanes)


def digests(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """BLAKE2b of words first[i] .. last[i] - 1 joined by blanks, for each i: rows of two longs."""
    at = places(words)
    view = memoryview(joined(words).tobytes())
    raw = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)])
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)


def cut(buf: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], seeds: int = 1) -> Words:
    """Cut documents (buf[offsets[d]:offsets[d + 1]]) into words and hash each word; without seeds, no hashes."""
    inside, fold = table
    buf = fold[buf]
    n = len(buf)
    member = np.zeros(n + 2, dtype=bool)
    member[1 : n + 1] = inside[buf]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    here, before = member[1 : n + 2], member[: n + 1]
    starts = np.flatnonzero(here & (~before | fresh))
    ends = np.flatnonzero(before & (~here | fresh))
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    hashes = []
    for k in range(seeds):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_table(k)[buf] * powers(_ODD[k], n), out=total[1:])
        h = (total[ends] - total[starts]) * powers(inverse(_ODD[k]), n + 1)[starts]
        hashes.append(mix(h + (ends - starts).astype(np.uint64)))
    return Words(buf, starts, ends, bounds, doc, tuple(hashes), member[1 : n + 1])


def windows(words: Words, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of `length` words inside one document."""
    h = words.hashes[seed]
    n = len(h)
    if n < length:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(_WORD_ODD[seed], n), out=total[1:])
    first = np.flatnonzero(words.doc[: n - length + 1] == words.doc[length - 1 :])
    value = (total[first + length] - total[first]) * powers(inverse(_WORD_ODD[seed]), n)[first]
    return first, mix(value + U64(length))


def spans_hash(words: Words, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """Hash of words first[i] .. last[i] - 1 for each i, any lengths."""
    h = words.hashes[seed]
    n = len(h)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(_WORD_ODD[seed], n), out=total[1:])
    value = (total[last] - total[first]) * powers(inverse(_WORD_ODD[seed]), n + 1)[first]
    return mix(value + (last - first).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most `rows` rows and about `limit` bytes; null counts as empty.

    A row is never split: one very long text makes a chunk of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + rows, len(texts))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
