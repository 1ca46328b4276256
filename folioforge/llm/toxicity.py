"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
its distinct words (hashed); a document's score is the noisy-or of its
sentences, 1 - prod(1 - p).  Only document labels are needed: the gradient of
the noisy-or gives the blame for a toxic document to the sentences that explain
it, and the same scores then locate the offending sentences.

The model is fitted on a bounded sample of labelled rows, SAMPLE documents of
least hash and of these no more than SAMPLE_BYTES of text; everything else
covers all data.  Words are counted by class on the executors and screened by
their smoothed log-odds, which also start the descent; only the screened words
of the sample's sentences reach the driver.

Defined results: null or empty text is one empty sentence and gets the score of
the intercept; null labels are not learned from; without any label, or with one
class only, every score is that of the intercept; a label that occurs more than
once counts once, and so does a document, by its least text; a null doc_id is
never held out; an empty table gives an empty result, and a very long text is
scored whole, sentence by sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X
from .tables import shared_dir, table, written

#: Labelled documents that the fit takes at most, and the fold that it never sees.
SAMPLE, FOLDS, HELD_OUT = 20_000, 5, 0
#: Bytes of their texts at most; the document that passes them ends the sample.
SAMPLE_BYTES = 64 << 20
BITS, EPOCHS, RATE, DECAY = 20, 150, 0.2, 1e-5
#: A word needs this many documents, and log-odds of this size, to have a weight.
LEAST_DOCS, LEAST_ODDS = 3, 0.5
INTERCEPT = -8.0

WORDS = X.word_table(separators=bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)), lower=True)
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?\n|")] = True


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


def _sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word features, their sentences, each sentence's document, last byte of each sentence); a sentence ends after . ! ? | or a line."""
    words = X.cut(buf, offsets, WORDS)
    stop = _STOPS[buf].copy()
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    stop[ends] = True
    last = np.flatnonzero(stop)
    sentence = np.searchsorted(last, words.starts)
    # Each empty document gets a sentence of its own, without words.
    doc_of = np.searchsorted(offsets, last, side="right") - 1
    empty = np.flatnonzero(np.diff(offsets) == 0)
    feature = (words.hashes[0] >> X.U64(64 - BITS)).astype(np.int64)
    return feature, sentence, np.concatenate((doc_of, empty)), last


@dataclass
class Screen:
    """Words that tell the classes apart: their first weights by hash, 0 for all others, and toxic documents seen."""

    weights: np.ndarray
    toxic: int


def count_words(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, toxic documents with it, others with it) of a batch."""
    size = 1 << BITS
    pos, neg = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for lo, _hi, buf, offsets in X.chunks(texts):
        f, s, d, _ = _sentences(buf, offsets)
        held = np.unique((lo + d[s]) << BITS | f)
        bad = toxic[held >> BITS]
        pos += np.bincount(held[bad] & (size - 1), minlength=size)
        neg += np.bincount(held[~bad] & (size - 1), minlength=size)
    word = np.flatnonzero(pos + neg)
    return word, pos[word], neg[word]


def screen(word: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> Screen:
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    seen = pos + neg
    weights = odds * seen / (seen + 12)
    live = (seen >= LEAST_DOCS) & (np.abs(weights) >= LEAST_ODDS)
    out = np.zeros(1 << BITS)
    out[word[live]] = weights[live]
    return Screen(out, n_pos)


def bags(texts: pa.Array, live: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, screened words, their sentences, each sentence's document) by chunks, documents and sentences from 0 in each."""
    for lo, hi, buf, offsets in X.chunks(texts):
        f, s, d, _ = _sentences(buf, offsets)
        keep = live[f]
        key = np.unique(s[keep] << BITS | f[keep])
        yield lo, hi, key & ((1 << BITS) - 1), key >> BITS, d


def descend(start: Screen, feat: np.ndarray, sent: np.ndarray, doc: np.ndarray, y: np.ndarray) -> Model:
    """Noisy-or model of (word, sentence) pairs, each sentence's document and each document's label; one machine, bounded by the sample."""
    n_sent, n_doc, weights = len(doc), len(y), start.weights.copy()
    used, at = np.unique(feat, return_inverse=True)
    w, b = weights[used], INTERCEPT
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    first = w.copy()
    for t in range(1, EPOCHS + 1):
        z = np.bincount(sent, weights=w[at], minlength=n_sent) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_doc))
        blame = np.where(y, -none / np.maximum(1 - none, 1e-9), 1.0)[doc] * p
        g = np.append(np.bincount(at, weights=blame[sent], minlength=len(used)) + DECAY * start.toxic * (w - first), blame.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights[used] = w
    return Model(weights, float(b))


def _plain() -> Model:
    return Model(np.zeros(1 << BITS), INTERCEPT)


def _crc32_text(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("long").cast("string"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(_crc32_text(doc_id), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> DataFrame | None:
    """text, toxic of the labelled documents to learn from, as a table of bounded size."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out()).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    one = written(one.withColumn("key", F.xxhash64("doc_id")), f"{shared_dir(docs.sparkSession)}/sample")
    sizes = sorted((r.key, r.n) for r in one.select("key", F.octet_length("text").alias("n")).toLocalIterator())  # at most `sample` pairs of numbers
    if not sizes:
        return None
    within = int(np.searchsorted(np.cumsum([n for _, n in sizes]), sample_bytes))
    return one.filter(F.col("key") <= sizes[min(within, len(sizes) - 1)][0]).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    rows = _sample(docs, labels, sample, sample_bytes)
    of = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()} if rows is not None else {}
    if len(of) < 2:
        return _plain()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = count_words(batch.column(0), batch.column(1).to_numpy().astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "pos", "neg"])

    # A word that could not pass even alone never leaves the executors.
    counted = rows.mapInArrow(count, "word long, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") + F.col("neg") >= LEAST_DOCS).toArrow()
    start = screen(*(counted[c].to_numpy() for c in ("word", "pos", "neg")), of[1], of[0])
    live = start.weights != 0

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, feat, sent, doc in bags(batch.column(0), live):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((feat.astype(np.int32), pa.list_(pa.int32())), (sent.astype(np.int32), pa.list_(pa.int32())), (doc.astype(np.int32), pa.list_(pa.int32())), (batch.column(1)[lo:hi].to_numpy(), pa.list_(pa.int32())))], names=["feat", "sent", "doc", "toxic"])

    taken = rows.mapInArrow(bag, "feat array<int>, sent array<int>, doc array<int>, toxic array<int>").toArrow()  # bounded by the sample
    feat, sent, doc, y, n_sent, n_doc = [], [], [], [], 0, 0
    for f, s, d, label in zip(*(taken[c] for c in ("feat", "sent", "doc", "toxic")), strict=True):
        f, s, d, label = (x.values.to_numpy() for x in (f, s, d, label))
        feat.append(f)
        sent.append(s + n_sent)
        doc.append(d + n_doc)
        y.append(label)
        n_sent, n_doc = n_sent + len(d), n_doc + len(label)
    return descend(start, np.concatenate(feat), np.concatenate(sent), np.concatenate(doc), np.concatenate(y).astype(bool))


RESULT = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending string"


def _scored(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks: first and end row, each document's score, each sentence's score, document and last byte, the bytes and the documents' offsets."""
    for lo, hi, buf, offsets in X.chunks(texts):
        feature, sentence, doc, last = _sentences(buf, offsets)
        use = model.weights[feature] != 0
        key = np.unique(sentence[use] << BITS | feature[use])
        z = np.bincount(key >> BITS, weights=model.weights[key & ((1 << BITS) - 1)], minlength=len(doc)) + model.intercept
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = 1 - np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=hi - lo))
        yield lo, hi, total, p, doc, last, buf, offsets


def score(docs: DataFrame, model: Model) -> DataFrame:
    """RESULT: each document's noisy-or score and its offending sentences as start:end in code points."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, total, p, doc, last, buf, offsets in _scored(held.value, batch.column(2)):
                where: list[list[str]] = [[] for _ in range(hi - lo)]
                for s in np.flatnonzero(p[: len(last)] >= 0.5).tolist():
                    d = int(doc[s])
                    begin = max(int(offsets[d]), int(last[s - 1]) + 1 if s else 0)
                    before = int(np.count_nonzero((buf[offsets[d] : begin] & 0xC0) != 0x80))
                    where[d].append(f"{before}:{before + int(np.count_nonzero((buf[begin : last[s] + 1] & 0xC0) != 0x80))}")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(total), pa.array((total >= 0.5).astype(np.int32)), pa.array(np.bincount(doc, minlength=hi - lo)), pa.array([",".join(x) for x in where], pa.string())],
                    names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"],
                )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(step, RESULT)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs whose score is below a half; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, total, *_ in _scored(held.value, batch.column(at)):
                if (total < 0.5).any():
                    yield batch.slice(lo, hi - lo).filter(pa.array(total < 0.5))

    return docs.mapInArrow(step, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
