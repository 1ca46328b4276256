"""Importance resampling of documents towards a target corpus.

Features are runs of words hashed into buckets.  One pass over the documents
writes, side by side, a row for each document and the inverted postings: for
each bucket and run of documents the documents that hold it with their counts
(`body`), which is all that is shuffled.  Postings are shuffled by bucket; where
a bucket's postings meet, its counts in both corpora are co-grouped and give its
gain, and every posting gives its document a contribution of count times gain.
Contributions are summed by document, partially before they are shuffled.

A bucket that most documents hold is no burden for one task: its counts are
summed partially, and the join that brings its gain to its postings deals both
sides anew, so adaptive execution can split it.  Ranks come from a range
partitioned sort and the sizes of its ranges, not from one task.

Defined results: null or empty text has no features and weight 0; a null doc_id
counts in the corpus' features, but its row isn't among the documents drawn
from and has neither score nor rank; repeated rows are documents of their own,
with equal scores and, if drawn, ranks one after the other; a target without
features, or an empty table, is as the formula has it; a very long text is
counted in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .counting import counted
from .tables import shared_dir, table, written

BUCKETS, RUNS = 10_000, 1
LEAST_WORDS, PER_CENT, SEED = 20, 10, 2024
#: Documents that share a run of postings (their places in it are 16 bits), and postings after which a run ends.
RUN_DOCS, RUN_POSTINGS = 1 << 16, 1 << 20

#: Rows of documents have no bucket, postings no doc_id.
GATHERED = "bucket int, base long, n long, body binary, row long, doc_id long, n_features long, n_words long"


def features(text: str | None, runs: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, features, their buckets, counts); a bucket may come more than once."""
    n_words, found = counted(text, runs)
    bucket = np.fromiter(map(crc32, found), np.int64, len(found)) % buckets
    count = np.fromiter(found.values(), np.int64, len(found))
    return n_words, int(count.sum()), bucket, count


def _starts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and where each starts."""
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))[: len(x)])
    return x[first], first


class _Run:
    """Postings of a run of documents."""

    def __init__(self, base: int):
        self.base, self.docs, self.size = base, 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, n_words: int, n: int, bucket: np.ndarray, count: np.ndarray) -> None:
        self.rows.append((self.base + self.docs, doc_id, n, n_words))
        self.parts.append((bucket, np.full(len(bucket), self.docs, np.int64), count))
        self.docs += 1
        self.size += len(bucket)

    def batch(self) -> pa.RecordBatch:
        bucket, doc, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        key = bucket * RUN_DOCS + doc
        order = np.argsort(key, kind="stable")
        key, new = _starts(key[order])
        count = np.add.reduceat(count[order], new) if len(new) else count
        doc = (key % RUN_DOCS).astype("<u2")
        bucket, first = _starts(key // RUN_DOCS)
        ends = np.append(first[1:], len(key))[: len(first)]
        total = np.add.reduceat(count, first) if len(first) else count
        wide = count.astype("<i8")
        body = [doc[a:b].tobytes() + wide[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        p, d = len(first), len(self.rows)
        none = lambda kind, k: pa.nulls(k, kind)
        rows, ids, n, n_words = zip(*self.rows, strict=True)
        columns = {
            "bucket": (pa.array(bucket, pa.int32()), none(pa.int32(), d)),
            "base": (pa.array(np.full(p, self.base), pa.int64()), none(pa.int64(), d)),
            "n": (pa.array(total, pa.int64()), none(pa.int64(), d)),
            "body": (pa.array(body, pa.binary()), none(pa.binary(), d)),
            "row": (none(pa.int64(), p), pa.array(rows, pa.int64())),
            "doc_id": (none(pa.int64(), p), pa.array(ids, pa.int64())),
            "n_features": (none(pa.int64(), p), pa.array(n, pa.int64())),
            "n_words": (none(pa.int64(), p), pa.array(n_words, pa.int64())),
        }
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns.values()], names=list(columns))


def gathered(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """Documents and postings, GATHERED.  A document's row number is its place in its task's input."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        run = _Run(at)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run.add(doc_id, *features(text.as_py(), runs, buckets))
                if run.docs == RUN_DOCS or run.size >= RUN_POSTINGS:
                    at += run.docs
                    yield run.batch()
                    run = _Run(at)
        if run.docs:
            yield run.batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(step, GATHERED)


def contributions(postings: DataFrame) -> DataFrame:
    """row, weight: each posting's count times its bucket's gain."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, gain = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, size = [], 0
            for b, g, body in zip(base.tolist(), gain.tolist(), batch.column(2), strict=True):
                raw = body.as_buffer()
                n = raw.size // 10
                held.append((b + np.frombuffer(raw, "<u2", n).astype(np.int64), g * np.frombuffer(raw, "<i8", n, 2 * n)))
                size += n
                if size >= RUN_POSTINGS:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)

    return postings.select("base", "gain", "body").mapInArrow(step, "row long, weight long")


def _rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    row, weight = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(weight)], names=["row", "weight"])


def weighed(docs: DataFrame, target: DataFrame, work: str, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_features, n_words, weight of every document."""
    own = written(gathered(docs, runs, buckets), f"{work}/postings")
    other = gathered(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), runs, buckets)
    postings = own.filter(F.col("bucket").isNotNull())
    of_docs = postings.groupBy("bucket").agg(F.sum("n").alias("s"))
    of_target = other.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("n").alias("t"))
    # One row for each bucket: the two corpora, co-grouped.
    counts = written(of_docs.join(of_target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), f"{work}/counts")
    whole = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(whole["s"] + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(whole["t"] + buckets)))
    gains = counts.filter("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))
    given = contributions(postings.join(gains.hint("merge"), "bucket"))
    every = own.filter(F.col("bucket").isNull()).select("row", F.lit(0).cast("long").alias("weight"), "doc_id", "n_features", "n_words")
    each = given.groupBy("row").agg(F.sum("weight").alias("weight")).unionByName(every, allowMissingColumns=True)
    return each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_features").alias("n_features"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"))


def _ranked(rows: DataFrame, most: int, work: str) -> DataFrame:
    """row, rank of the `most` first by falling score, then doc_id: a range of the order in each partition, ranges counted, places added up."""
    place = F.monotonically_increasing_id()
    dealt = rows.select("row", "score", "doc_id").repartitionByRange(F.desc("score"), F.asc("doc_id"), F.asc("row")).sortWithinPartitions(F.desc("score"), F.asc("doc_id"), F.asc("row"))
    placed = written(dealt.select("row", F.shiftright(place, 33).alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), f"{work}/order")
    before, starts = 0, []
    for r in placed.groupBy("range").count().orderBy("range").collect():  # a row for each partition
        starts.append((r["range"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "range long, before long")
    return placed.join(offsets, "range").select("row", (F.col("before") + F.col("at") + 1).alias("rank")).filter(F.col("rank") <= most)


def resample(docs: DataFrame, target: DataFrame, work: str, runs: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_features, n_words, weight, score and rank (null: not drawn) of every document."""
    digest = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((digest + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weighed(docs, target, work, runs, buckets).withColumn("score", F.col("weight") + noise), f"{work}/scored")
    pool = scored.filter((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    ranks = _ranked(pool, per_cent * pool.count() // 100, work)
    return scored.join(ranks, "row", "left")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_dir(spark))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def brute(docs: list[tuple[int | None, str | None]], target: list[str | None], runs: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> list[tuple]:
    """The contract, feature by feature; for tests on small inputs."""
    import hashlib
    import math
    import re

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def held(t):
        w = cut(t)
        return [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in held(text):
            s[b] += 1
    for text in target:
        for b in held(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, pool = [], []
    for i, (doc, text) in enumerate(docs):
        own = held(text)
        weight = sum(gain[b] for b in own)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(cut(text)) >= least_words:
                pool.append((-score, doc, i))
        out.append([doc, len(own), weight, score, None])
    for rank, (_, _, i) in enumerate(sorted(pool)[: per_cent * len(pool) // 100], 1):
        out[i][4] = rank
    return [tuple(x) for x in out]


#: CRC-32 as SQL: the table of a byte by eight steps of its polynomial, then a fold over the bytes of each distinct word.
ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT range AS b, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS of_byte FROM steps WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x FROM d), ew AS (SELECT unnest(w) AS x FROM e),
bytes AS (SELECT x, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS b FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM ew))),
bucket AS (SELECT x, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, y: xor(of_byte[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucket USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM ew JOIN bucket USING (x) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM ew) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN bucket USING (x) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranked) THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
