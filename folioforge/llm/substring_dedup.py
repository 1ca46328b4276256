"""Exact removal of repeated passages, over a log-structured fingerprint index.

A window is `WINDOW` consecutive words.  Each window has one anchor, the word
run of `GRAM` words in it with the least hash, which depends on the window's
words alone; equal windows so have equal anchors.  Neighbouring windows with
one anchor make a segment, some twenty windows long, and the index holds one
entry per anchor and distinct segment instead of one per window:

    anchor, seg and seg2 (128 bits of BLAKE2b of the segment's words), its first
    document and place (doc_id, row_key, first, n), last (greatest doc_id that has it)

The index is a log of immutable runs sorted by anchor.  Batches of documents
come in ascending order of doc_id.  Each batch's run is appended; the batch is
merge-joined with the index, old runs and its own; its hits are verified, as
anchors only say where to look: by the digest of the segment's words where an
earlier document has the same segment, else (edges of a repeated passage) window
by window, by such digests of the windows of one occurrence of each distinct
segment, which are read again from the documents; then runs are compacted once there are more than `fanout`.

The log's folder holds the runs and, for each batch taken, a manifest: the runs
that count, and the greatest doc_id so far.  A batch is taken once its manifest
is written; what a lost attempt leaves behind is in none and is written over.  A
log is opened again by its folder, and the next batch goes on from there.

Defined results: null or empty text has no words and no windows; a document
never removes its own repeats; documents of equal doc_id don't remove each
other's windows; a null doc_id is smaller and larger than none, so its row
neither removes nor loses words; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X
from .tables import exists, remove, row_key, shared_dir, table, written

WINDOW = 50
GRAM = 10
#: Batches of like size (ascending ranges of doc_id) that the query feeds to the index, and runs it keeps.
BATCHES, FANOUT = 3, 2
#: Words' hashes for anchors, which only say where to look; a fixed key, as an index outlives its run.
ANCHOR_KEY = 1

SEGMENTS = "anchor long, seg long, seg2 long, doc_id long, row_key long, first int, n int"


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams the place of the least hash, the leftmost of equals.

    The hash's upper 40 bits and the place make one sortable number; the grams
    are taken in blocks whose places fit in the other 24 bits.
    """
    out = []
    block = (1 << 24) - width
    for base in range(0, len(grams) - width + 1, block):
        part = grams[base : base + block + width - 1]
        key = (part & X.U64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64)
        span, have = 1, key
        while span * 2 <= width:
            have = np.minimum(have[: len(have) - span], have[span:])
            span *= 2
        if span < width:
            have = np.minimum(have[: len(have) - (width - span)], have[width - span :])
        out.append((have & X.U64(0xFFFFFF)).astype(np.int64) + base)
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def segments_of(words: X.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, the segment's digest as rows of two longs, first window, windows) of each segment of a chunk."""
    n = len(words.starts)
    none = np.empty(0, dtype=np.int64)
    if n < window:
        return none, none.reshape(0, 2), none, none
    h = words.hashes[0]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * X.powers(X._WORD_ODD[0], n), out=total[1:])
    every = np.arange(n - gram + 1)
    grams = X.mix((total[every + gram] - total[every]) * X.powers(X.inverse(X._WORD_ODD[0]), n)[every])
    at = _anchors(grams, window - gram + 1)
    first = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
    if not len(first):
        return none, none.reshape(0, 2), none, none
    at = at[first]
    opens = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1))))
    lo = first[opens]
    count = np.diff(np.concatenate((opens, [len(first)])))
    return X.signed(grams[at[opens]]), X.digests(words, lo, lo + count - 1 + window), lo, count


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Segments of all documents with a doc_id: SEGMENTS."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _hi, buf, offsets in X.chunks(batch.column(2)):
                words = X.strong(X.cut(buf, offsets, X.BLANK_WORDS, seeds=0), ANCHOR_KEY)
                anchor, digest, first, count = segments_of(words, window, gram)
                d = words.doc[first] if len(first) else first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), *map(pa.array, digest.T.copy()), pa.array(ids[lo + d]), pa.array(keys[lo + d]), pa.array((first - words.bounds[d]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["anchor", "seg", "seg2", "doc_id", "row_key", "first", "n"],
                )

    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), row_key().alias("row_key"), "text").mapInArrow(step, SEGMENTS)


MANIFEST = "runs array<int>, upto long, made int"
PLACE = ("doc_id", "row_key", "first", "n")
SEG = ("seg", "seg2")
WIN = ("anchor", "win", "win2")


class FingerprintLog:
    """Immutable runs of index entries in a shared folder, with a manifest; opened where the folder has one."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.paths: list[str] = []
        self.made, self.upto, self.gone = 0, None, []
        if exists(spark, f"{path}/manifest"):
            last = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("made")).first()
            if last is not None:
                self.made, self.upto = last["made"], last["upto"]
                self.paths = [f"{path}/run-{n}" for n in last["runs"]]

    def commit(self, upto: int | None) -> None:
        """From here on the runs as they are now count; those that they replace go."""
        self.upto = upto if upto is not None else self.upto
        runs = [int(p.rpartition("-")[2]) for p in self.paths]
        self.spark.createDataFrame([(runs, self.upto, self.made)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={self.made}")
        for path in self.gone:
            remove(self.spark, path)
        self.gone = []

    def take(self, fresh: DataFrame, until: DataFrame, work: str, window: int = WINDOW) -> DataFrame:
        """Spans to remove from a batch of documents (doc_id, row_key, first, n), which then is part of the index.

        Its doc_ids come after all that the log has taken; until: the batch and all before it.
        """
        ids = F.col("doc_id").cast("long")
        ends = fresh.agg(F.min(ids).alias("low"), F.max(ids).alias("high")).first()
        if self.upto is not None and ends["low"] is not None and ends["low"] <= self.upto:
            raise ValueError(f"the log has taken documents up to {self.upto}; a batch that begins at {ends['low']} comes too late")
        found = written(segments(fresh, window), f"{work}/segments")
        self.append(found)
        hits = written(self.probe(found, f"{work}/shared"), f"{work}/hits")
        spans = written(removed_spans(until, hits, self, f"{work}/open", window), f"{work}/spans")
        self.settle()
        self.commit(ends["high"])
        for name in ("segments", "shared", "hits", "open"):
            remove(self.spark, f"{work}/{name}")
        return spans

    @staticmethod
    def _summary(df: DataFrame) -> DataFrame:
        """One row of each anchor and segment: its least place and its last document."""
        one = df.groupBy("anchor", *SEG).agg(F.min(F.struct(*PLACE)).alias("at"), F.max("last").alias("last"))
        return one.select("anchor", *SEG, "at.*", "last")

    def _write(self, df: DataFrame) -> None:
        self.made += 1
        path = f"{self.path}/run-{self.made}"
        written(df.sortWithinPartitions("anchor"), path)
        self.paths.append(path)

    def append(self, found: DataFrame) -> None:
        """A batch's segments as a new run."""
        self._write(self._summary(found.withColumn("last", F.col("doc_id"))))

    def settle(self) -> None:
        """Compact beyond `fanout` runs."""
        if len(self.paths) > self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one and drop the old files once it is written."""
        old = self.paths
        if len(old) < 2:
            return
        self.paths = []
        self._write(self._summary(self.spark.read.parquet(*old)))
        # A manifest may still name them.
        self.gone += old

    def entries(self) -> DataFrame:
        """Rows of all runs; an anchor and segment may be in several."""
        return self.spark.read.parquet(*self.paths)

    def probe(self, found: DataFrame, path: str) -> DataFrame:
        """Segments whose anchor an earlier document or another segment has, with `mixed`: more than one segment has it.

        The anchors that recur become a table of their own at `path`, so that the join deals both sides anew and can split a hot one.
        """
        known = self.entries().groupBy("anchor").agg(F.min("doc_id").alias("doc_lo"), F.max("last").alias("doc_hi"), ((F.min("seg") != F.max("seg")) | (F.min("seg2") != F.max("seg2"))).alias("mixed"))
        shared = written(known.filter(F.col("mixed") | (F.col("doc_lo") < F.col("doc_hi"))).select("anchor", "doc_lo", "mixed"), path)
        return found.join(shared.hint("merge"), "anchor").filter(F.col("mixed") | (F.col("doc_id") > F.col("doc_lo"))).drop("doc_lo")

    def firsts(self, anchors: DataFrame) -> DataFrame:
        """The first place of each segment of some anchors: anchor, seg and PLACE."""
        found = self.entries().join(anchors.hint("merge"), "anchor", "left_semi")
        # Dealt anew, so that the join may split an anchor of very many segments.
        return self._summary(found.repartition("anchor", *SEG)).drop("last")


def removed_spans(docs: DataFrame, hits: DataFrame, log: FingerprintLog, work: str, window: int = WINDOW) -> DataFrame:
    """doc_id, row_key, first, n: runs of windows to remove from a batch, from its probed segments.

    docs: the batch's documents and all before it.
    """
    mixed = hits.filter("mixed").select("anchor", *SEG, *PLACE)
    # Tables of their own, so that joins deal both sides anew and can split a hot key.
    firsts = written(log.firsts(mixed.select("anchor").distinct()), f"{work}/firsts")
    seg_doc = firsts.select("anchor", *SEG, F.col("doc_id").alias("seg_doc"))
    placed = written(mixed.join(seg_doc.hint("merge"), ["anchor", *SEG]).select("anchor", *PLACE, "seg_doc"), f"{work}/placed")
    whole = hits.filter(~F.col("mixed")).select(*PLACE).unionByName(placed.filter("doc_id > seg_doc").select(*PLACE))
    # Windows of one occurrence of each segment: in the batch wherever its first document has it, before the batch its first place.
    opened = placed.filter("doc_id = seg_doc").select("anchor", *PLACE)
    before = firsts.join(opened.select("doc_id").distinct().withColumnRenamed("doc_id", "own"), F.col("doc_id") == F.col("own"), "left_anti").select("anchor", *PLACE)
    parts = opened.unionByName(before).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "n", "anchor")).alias("parts"))
    wins = parts.join(_keyed(docs).hint("merge"), ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "parts").mapInArrow(_window_rows(window), "anchor long, win long, win2 long, doc_id long, row_key long, first int")
    wins = written(wins, f"{work}/windows")
    first_doc = wins.groupBy(*WIN).agg(F.min("doc_id").alias("win_doc"), F.max("doc_id").alias("last_doc")).filter("win_doc < last_doc")
    own = opened.select("doc_id", "row_key").distinct()
    single = wins.join(own, ["doc_id", "row_key"], "left_semi").join(first_doc.hint("merge"), list(WIN)).filter("doc_id > win_doc").select("doc_id", "row_key", "first", F.lit(1).alias("n"))
    return whole.unionByName(single)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")


def _window_rows(window: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = batch.column(3)
            for lo, hi, buf, offsets in X.chunks(batch.column(2)):
                words = X.cut(buf, offsets, X.BLANK_WORDS, seeds=0)
                own = parts[lo:hi]
                doc = np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy())
                flat = own.flatten()
                first, n, anchor = (flat.field(k).to_numpy() for k in range(3))
                i = np.repeat(first.astype(np.int64) + words.bounds[doc], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc, anchor = np.repeat(doc, n), np.repeat(anchor, n)
                digest = X.digests(words, i, i + window)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *map(pa.array, digest.T.copy()), pa.array(ids[lo + doc]), pa.array(keys[lo + doc]), pa.array((i - words.bounds[doc]).astype(np.int32))], names=[*WIN, "doc_id", "row_key", "first"])

    return step


def dedup(docs: DataFrame, work: str, window: int = WINDOW, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, row_key, text, spans: each document with the spans of words to remove (null: none).

    The corpus comes in `batches` of like size, in ascending order of doc_id,
    as it would day by day; each meets the index of those before it.
    """
    spark = docs.sparkSession
    log = FingerprintLog(spark, f"{work}/index", fanout)
    ids = F.col("doc_id").cast("long")
    cuts = docs.agg(F.percentile_approx(ids, [k / batches for k in range(1, batches)] or [1.0], 1000).alias("cuts")).first()["cuts"]
    if cuts is None:
        return _keyed(docs).withColumn("spans", F.lit(None).cast("array<struct<first:int,n:int>>"))
    bounds = [None, *sorted(set(cuts[: batches - 1])), None]
    found: DataFrame | None = None
    for b, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        until = docs if high is None else docs.filter(ids <= high)
        spans = log.take(until if low is None else until.filter(ids > low), until, f"{work}/batch-{b}", window)
        found = spans if found is None else found.unionByName(spans)
    return _spanned(docs, found)


def _spanned(docs: DataFrame, found: DataFrame) -> DataFrame:
    all_spans = found.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    return _keyed(docs).join(all_spans.hint("merge"), ["doc_id", "row_key"], "left")


def dedup_next(fresh: DataFrame, history: DataFrame, log: str, work: str, window: int = WINDOW, fanout: int = FANOUT) -> DataFrame:
    """dedup() of the next batch alone, against the log in the folder `log`, which is begun there or opened again.

    history: all documents that the log has taken before.
    """
    both = history.select("doc_id", "text").unionByName(fresh.select("doc_id", "text"))
    return _spanned(fresh, FingerprintLog(fresh.sparkSession, log, fanout).take(fresh, both, work, window))


def kept(deduped: DataFrame, window: int = WINDOW, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (body.as_py() or "").encode().split()
                gone = 0
                left = words
                if spans.is_valid and len(spans):
                    delta = np.zeros(len(words) + 1, dtype=np.int64)
                    flat = spans.values
                    first, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
                    np.add.at(delta, first, 1)
                    np.add.at(delta, first + n - 1 + window, -1)
                    stay = np.cumsum(delta[:-1]) <= 0
                    gone = len(words) - int(stay.sum())
                    left = compress(words, stay.tolist())
                joined = b" ".join(left)
                for column, x in zip(rows, (len(words), gone, hashlib.sha256(joined).hexdigest(), joined.decode() if text else None), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())][: 5 if text else 4], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if text else 4])

    return deduped.select("doc_id", "text", "spans").mapInArrow(step, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(dedup(table(spark, sf_dir, "documents"), shared_dir(spark)))


def brute(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract, window by window; for tests on small inputs."""
    cut = [(i, (t or "").encode().split()) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, w in cut:
        for a in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[a : a + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and least[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        left = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (s) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
left_ AS (SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS body
          FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (doc_id)
"""
