"""Ranked lexical search: the best documents for each item of a query set.

One pass cuts every text and keeps, for each document, how many terms it has and
the query terms among them with their counts.  That table is range partitioned
by document and written; it gives the statistics (documents, terms, documents
that hold a term).  Then each range is scored by itself: postings are matched
with the items that ask for their term, the matched item, document and impact
arrays are concatenated, packed keys (item, document) are radix sorted by 16-bit
digits, and runs of one key are summed by reduceat.  A heap of the best `top`
for each item goes through a range; the ranges' heaps meet in one limited window.

The query set is held by executors as a dictionary of its terms, at most
BLOCK_BYTES of its text at a time; a larger one is searched block by block, one
alive at a time, each block against all documents.

Defined results: null or empty text has no terms and is not found, nor is a row
of null doc_id, though its terms count in the statistics; repeated documents
are documents of their own (equal doc_ids are then all ranked); an item of no
terms finds nothing; repeated items (equal item_id and text) are one, items of
equal item_id and different texts are ranked each by itself; an empty table
gives an empty result; a very long text is counted in pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .counting import counted
from .tables import remove, shared_dir, table, written

TOP = 20
#: Bytes of query text held at a time, and matched entries sorted at once.
BLOCK_BYTES, ENTRIES = 16 << 20, 1 << 20

MATCHED = "row long, doc_id long, n long, terms array<int>, counts array<long>"


class Queries:
    """Terms of a block of items: a number for each, and for each number the items that ask for it and how often."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        asked: list[list[tuple[int, int]]] = []
        for place, (_, text) in enumerate(items):
            for term, times in counted(text)[1].items():
                at = self.number.setdefault(term, len(asked))
                if at == len(asked):
                    asked.append([])
                asked[at].append((place, times))
        self.first = np.cumsum([0, *map(len, asked)])
        flat = np.array([x for own in asked for x in own], np.int64).reshape(-1, 2)
        self.item, self.times = flat[:, 0].copy(), flat[:, 1].copy()


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """Distinct items in parts of at most about `limit` bytes of text."""
    own = items.select("item_id", "text").distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) or 1
    return [own] if n == 1 else [own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)) == b) for b in range(2 * n)]


def matched(docs: DataFrame, held) -> DataFrame:
    """Every document's number of terms and the query terms it holds, MATCHED."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.number
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths, terms, counts, sizes = [], [], [], [0]
            for text in batch.column(1):
                n, found = counted(text.as_py())
                own = found.keys() & number.keys()
                terms += [number[t] for t in own]
                counts += [found[t] for t in own]
                lengths.append(n)
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["row", "doc_id", "n", "terms", "counts"])
            row += batch.num_rows

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(step, MATCHED)


def radix_order(key: np.ndarray, top: int) -> np.ndarray:
    """The stable order of keys below `top`, digit by digit of 16 bits (which numpy sorts by counting)."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while top - 1 >> shift:
        digit = (key >> shift & 0xFFFF).astype(np.uint16)[order]
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def norms(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """75 + (25 * n * docs) div total, exact beyond 64 bits on the way."""
    if len(n) and int(n.max()) * 25 * docs >= 1 << 63:
        return np.array([75 + 25 * x * docs // total for x in n.tolist()], np.int64)
    return 75 + 25 * n * docs // total


class Accumulator:
    """Best documents of each item over a range of documents."""

    def __init__(self, queries: Queries, weight: np.ndarray, docs: int, total: int, top: int):
        self.q, self.weight, self.docs, self.total, self.top = queries, weight, docs, total, top
        self.heaps: dict[int, list[tuple[int, int]]] = {}

    def add(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Some documents: ids, numbers of terms, numbers of query terms, and these one after the other."""
        reach = self.q.first[terms + 1] - self.q.first[terms]
        ends = np.cumsum(sizes)
        entries = np.concatenate(([0], np.cumsum(reach)))[ends] if len(ends) else ends
        lo = 0
        while lo < len(ids):
            done = entries[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(entries, done + ENTRIES, side="right")))
            a, b = (ends[lo - 1] if lo else 0), ends[hi - 1]
            self._score(ids[lo:hi], n[lo:hi], sizes[lo:hi], terms[a:b], counts[a:b], reach[a:b])
            lo = hi

    def _score(self, ids, n, sizes, terms, counts, reach) -> None:
        if not len(terms):
            return
        doc = np.repeat(np.arange(len(ids)), sizes)
        m = norms(n, self.docs, self.total)[doc]
        impact = self.weight[terms] * (1_000_000_000 * counts // (1000 * counts + 12 * m))
        # Each posting once for each item that asks for its term.
        at = np.repeat(self.q.first[terms] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        key = self.q.item[at] * len(ids) + np.repeat(doc, reach)
        impact = np.repeat(impact, reach) * self.q.times[at]
        order = radix_order(key, len(self.q.ids) * len(ids))
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(impact[order], new)
        item, doc = np.divmod(key[new], len(ids))
        cuts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self._select(int(item[a]), total[a:b], ids[doc[a:b]])

    def _select(self, item: int, total: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps.setdefault(item, [])
        least = max(1, heap[0][0] if len(heap) == self.top else 1)
        if len(total) > self.top:
            least = max(least, int(np.partition(total, len(total) - self.top)[len(total) - self.top]))
        for s, i in zip(total[may].tolist(), ids[may].tolist(), strict=True) if (may := total >= least).any() else ():
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -i))
            else:
                heapq.heappushpop(heap, (s, -i))

    def rows(self) -> list[tuple[int, int, int]]:
        return [(item, -i, s) for item, heap in self.heaps.items() for s, i in heap]


def best(ranges: DataFrame, held, weight: np.ndarray, docs: int, total: int, top: int, kind) -> DataFrame:
    """query (an item's place in its block), item_id, doc_id, score: the best of each range."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        acc = Accumulator(queries, weight, docs, total, top)
        for batch in batches:
            terms, counts = batch.column(2), batch.column(3)
            acc.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), terms.value_lengths().to_numpy().astype(np.int64), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy())
        rows = acc.rows()
        for lo in range(0, len(rows), 1 << 16):
            item, doc, score = zip(*rows[lo : lo + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([queries.ids[i] for i in item], to_arrow_type(kind)), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "item_id", "doc_id", "score"])

    return ranges.select("doc_id", "n", "terms", "counts").mapInArrow(step, f"query int, item_id {kind.simpleString()}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, work: str, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    found: DataFrame | None = None
    for b, block in enumerate(blocks(items, block_bytes)):
        held = spark.sparkContext.broadcast(Queries([(r["item_id"], r["text"]) for r in block.toLocalIterator()]))
        ranges = written(matched(docs, held).repartitionByRange("doc_id", "row"), f"{work}/matched-{b}")
        stats = ranges.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        df = ranges.select(F.explode("terms").alias("term")).groupBy("term").count()
        weight = np.zeros(len(held.value.number), np.int64)
        rows = df.select("term", F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * stats["docs"] + 2)) / (2 * F.col("count") + 1).cast("double"))).alias("w")).collect()  # a row for each term of the block at most
        for r in rows:
            weight[r["term"]] = r["w"]
        one = best(ranges.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0)), held, weight, stats["docs"], stats["total"], top, kind)
        by_item = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
        one = written(one.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"), f"{work}/found-{b}")
        remove(spark, f"{work}/matched-{b}")
        held.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_dir(spark))


def brute(docs: list[tuple[int | None, str | None]], items: list[tuple[object, str | None]], top: int = TOP) -> list[tuple]:
    """The contract, term by term; for tests on small inputs."""
    import math
    import re
    from collections import Counter

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    held = [(i, Counter(cut(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in held]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for (doc, own), n in zip(held, lengths, strict=True):
            if doc is None or not n:
                continue
            m = 100 - 25 + 25 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * own[t] // (1000 * own[t] + 12 * m)) for t in cut(text) if own[t])
            if score > 0:
                scores.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:top], 1)]
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, x, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark) GROUP BY item_id, x),
st AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, x, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM d) GROUP BY doc_id, n, x),
df AS (SELECT x, floor(1000 * ln((2 * (SELECT n_docs FROM st) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p GROUP BY x),
sc AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))))::BIGINT AS score
       FROM q JOIN df USING (x) JOIN p USING (x), st GROUP BY item_id, doc_id),
rk AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM rk WHERE rank <= 20
"""
