"""Benchmark decontamination.

The normalised word windows of the benchmark make a hash set, sorted arrays of
some five times the text's size, that is shipped to the tasks once its size has
been checked.  A benchmark beyond the bound is scanned in blocks of at most that
size: one block at a time is built and shipped, its pass written, and let go
before the next; the passes' spans are united per document.  Each document is
read once per pass: its windows are looked up by 64-bit hash and every hit is
verified on the words themselves.

Normal form: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
An item of fewer words than a window, but not none, is one window.

Defined results: a null or empty text has no words, no hits and is clean; a
null item text has no windows; an empty benchmark hits nothing; items of equal
text are all reported, repeated rows of an item once; rows of equal doc_id are
judged apart; a null doc_id is carried through; an empty table gives an empty
result.  A single item, and a very long text, is never split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X
from .tables import row_key, shared_dir, table, written

WINDOW = 13
#: Bytes of benchmark text whose windows are held by a task at once.
BLOCK_BYTES = 16 << 20
SHARE = 20

SCAN = "doc_id long, row_key long, n_words long, starts array<int>, ends array<int>, items array<string>"


class WindowSet:
    """Hash set of benchmark windows as sorted arrays, with the words for verification."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names = [str(item) for item, _ in items]
        bodies: list[bytes] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        at = 0
        for lo, _hi, buf, offsets in X.chunks(pa.array([text for _, text in items], pa.large_string())):
            words = X.cut(buf, offsets, X.ALNUM_WORDS_LOWER)
            n = np.diff(words.bounds)
            # The words of all items of the chunk side by side, one space after each.
            bodies.append(words.text(0, len(words.starts)) + b" ")
            place = np.concatenate(([0], np.cumsum(words.ends - words.starts + 1))) + at
            at = int(place[-1]) if len(words.starts) else at + 1
            for length in {min(int(x), window) for x in np.unique(n) if x}:
                first, h = X.windows(words, length)
                use = np.minimum(n, window)[words.doc[first]] == length if len(first) else np.empty(0, bool)
                first, h = first[use], h[use]
                found.setdefault(length, []).append((h, lo + words.doc[first], place[first], place[first + length] - 1))
        self.text = b"".join(bodies)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        self.filters: dict[int, np.ndarray] = {}
        for length, parts in found.items():
            h, item, start, end = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((item, h))
            h, item, start, end = h[order], item[order], start[order], end[order]
            # A window that an item repeats is kept once.
            again = np.flatnonzero((h[1:] == h[:-1]) & (item[1:] == item[:-1])) + 1
            stay = np.ones(len(h), bool)
            stay[[k for k in again.tolist() if self.text[start[k] : end[k]] == self.text[start[k - 1] : end[k - 1]]]] = False
            self.by_length[length] = h[stay], item[stay].astype(np.int32), start[stay], (end - start)[stay].astype(np.int32)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[h >> X.U64(44)] = True
            self.filters[length] = seen
        self._known: dict[tuple[int, bytes], frozenset[str]] = {}

    def _items(self, length: int, lo: int, hi: int, body: bytes) -> frozenset[str]:
        """Items that have this window, of the entries lo to hi - 1 with its hash."""
        have = self._known.get((length, body))
        if have is None:
            _, item, start, size = self.by_length[length]
            have = frozenset(self.names[item[k]] for k in range(lo, hi) if self.text[start[k] : start[k] + size[k]] == body)
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[length, body] = have
        return have

    def hits(self, words: X.Words) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(first word, length, items) of each verified occurrence."""
        for length, (table, *_) in self.by_length.items():
            first, h = X.windows(words, length)
            maybe = np.flatnonzero(self.filters[length][h >> X.U64(44)])
            lo, hi = np.searchsorted(table, h[maybe], "left"), np.searchsorted(table, h[maybe], "right")
            for k in np.flatnonzero(lo < hi).tolist():
                i = int(first[maybe[k]])
                if items := self._items(length, int(lo[k]), int(hi[k]), words.text(i, i + length)):
                    yield i, length, items


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def scan(docs: DataFrame, held) -> DataFrame:
    """One pass: words of each document and its hit word spans (start, end exclusive)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, buf, offsets in X.chunks(texts):
                words = X.cut(buf, offsets, X.ALNUM_WORDS_LOWER)
                delta = np.zeros(len(words.starts) + 1, dtype=np.int32)
                items: list[set[str]] = [set() for _ in range(hi - lo)]
                for i, length, found in known.hits(words):
                    delta[i] += 1
                    delta[i + length] -= 1
                    items[words.doc[i]] |= found
                hit = np.cumsum(delta[:-1]) > 0
                starts, ends = [[] for _ in items], [[] for _ in items]
                for d, found in enumerate(items):
                    if found:
                        starts[d], ends[d] = _runs(hit[words.bounds[d] : words.bounds[d + 1]])
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], keys[lo:hi], pa.array(np.diff(words.bounds)), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["doc_id", "row_key", "n_words", "starts", "ends", "items"],
                )

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), "text").mapInArrow(step, SCAN)


def _blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) or 1
    return [items] if n == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)) == b) for b in range(2 * n)]


def _window_set(block: DataFrame, window: int) -> WindowSet:
    return WindowSet([(r.item_id, r.text) for r in block.toLocalIterator()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row_key, n_words, starts, ends (hit word spans), items, one row per document."""
    spark = docs.sparkSession
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        return scan(docs, spark.sparkContext.broadcast(_window_set(blocks[0], window)))
    work, passes = shared_dir(spark), []
    for b, block in enumerate(blocks):
        held = spark.sparkContext.broadcast(_window_set(block, window))
        one = scan(docs, held)
        passes.append(written(one if b == 0 else one.filter(F.size("items") > 0), f"{work}/pass-{b}"))
        held.destroy()
    found = passes[0]
    for other in passes[1:]:
        found = found.unionByName(other)
    united = found.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # Overlapping spans of several blocks become one: a span opens where it starts after all ends before it.
    reach = F.aggregate("spans", F.array().cast("array<struct<starts:int,ends:int>>"), _join_span)
    n_rows = passes[0].groupBy("doc_id", "row_key").agg(F.count("*").alias("copies"))
    merged = united.withColumn("spans", reach).join(n_rows, (united.doc_id.eqNullSafe(n_rows.doc_id)) & (united.row_key == n_rows.row_key)).select(united.doc_id, united.row_key, "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return merged.drop("copy")


def _join_span(acc, span):
    last = F.element_at(acc, -1)
    grown = F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], span["ends"]).alias("ends"))
    apart = (F.size(acc) == 0) | (span["starts"] > F.try_element_at(acc, F.lit(-1))["ends"])
    return F.when(apart, F.concat(acc, F.array(span))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))


def judged(found: DataFrame) -> DataFrame:
    """n_hit and the contamination rule on top of contamination()."""
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _clean_rows(docs: DataFrame, held) -> DataFrame:
    """docs without the documents that one block of the benchmark contaminates, in the pass that reads them."""
    at = docs.schema.fieldNames().index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            for lo, hi, buf, offsets in X.chunks(batch.column(at)):
                words = X.cut(buf, offsets, X.ALNUM_WORDS_LOWER)
                delta = np.zeros(len(words.starts) + 1, dtype=np.int32)
                for i, length, _ in known.hits(words):
                    delta[i] += 1
                    delta[i + length] -= 1
                hit = np.bincount(words.doc[np.cumsum(delta[:-1]) > 0], minlength=hi - lo)
                clean = (hit == 0) | (SHARE * hit < np.diff(words.bounds))
                if clean.any():
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean))

    return docs.mapInArrow(step, docs.schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents; all columns stay.

    With one block the pass itself drops them; with more, spans of all blocks count together.
    """
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        return _clean_rows(docs, docs.sparkSession.sparkContext.broadcast(_window_set(blocks[0], window)))
    bad = judged(contamination(docs, benchmark, window, block_bytes)).filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("row_key").alias("_bad_key")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_bad_key"]), "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def brute(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """The contract, word by word; for tests on small inputs."""
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins: dict[tuple, set[str]] = {}
    for item, text in items:
        w = cut(text)
        length = min(len(w), window)
        for i in range(len(w) - length + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + length]), set()).add(str(item))
    lengths = {len(x) for x in wins}
    out = {}
    for doc, text in docs:
        w, hit, ids = cut(text), set(), set()
        for length in lengths:
            for i in range(len(w) - length + 1):
                if found := wins.get(tuple(w[i : i + length])):
                    hit.update(range(i, i + length))
                    ids |= found
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and SHARE * len(hit) >= len(w))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.l = bw.l),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
