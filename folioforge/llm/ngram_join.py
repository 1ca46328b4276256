"""N-gram Jaccard self-join by PartEnum signatures, and its connected components.

A document's set holds its distinct word shingles.  Two sets of sizes l and m
that link differ in at most k(l, m) elements.  For each band of k the feature
domain is hashed into n1 partitions, each again into n2 parts; with n2 = 3 the
signatures are the contents of each two of the three parts, with n2 = 1 those
of each partition.  By counting, sets that differ in at most k elements have a
whole signature in common (k < 2 * n1 with n2 = 3, k < n1 with n2 = 1), and a
set gives signatures for every band that a partner's size can lead to, of as
many of the band's partitions, from the first on, as its own largest k asks for:
of two sets the one that gives fewer has given enough.

Signatures of nothing (an empty part) say nothing, so they are left out; a set
with so many empty parts that the counting could rest on them alone is hashed
again by the next of FAMILIES, and the last family gives all its signatures.
So no link is lost.

Words are hashed under a key drawn for each run, so a shingle's hash stands for its
words: no text can be made to collide, and by chance one in 2 ** 64 does.  Sets with
equal content are one class and one node: of equal size, and equal in two sums of
64 bits over hashes of their shingles that come from different halves of the words'
hashes.  Candidates of a signature
are not expanded into pairs: each node is first compared with the pivot of its
best signature; then, in signatures that still hold more than one component,
each node outside the largest component meets the others.  The join that lets
them meet lets only those pairs through whose parity sketches differ in no more
places than linked sets can (a sketch never overestimates); these are verified
on the texts.  A sketch has at least as many bits as its set has elements, so
it tells long texts apart as well as short ones; sets of up to 512 elements
share one size, larger ones also hold theirs folded to half, which is compared
with the next smaller size.  A signature with very much to compare is first
divided by the signatures of another family.

Signatures are computed once and written; they are matched in SLICES of their
hash, one after the other, so that no more than a slice is shuffled at a time.

Defined results: null, empty or blank text has the empty set and is linked with
nothing, not even with its like; rows of equal doc_id are one node, linked as
soon as one of their texts is; a null doc_id is linked with nothing and has a
null component.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as X
from .components import components
from .tables import remove, shared_dir, table, written

FAMILIES = 4
PARITY = tuple(f"p{i}" for i in range(8))
SKETCH = (*PARITY, "wide", "folded")
#: Comparisons within one signature beyond which it is divided by another family, at most `SPLITS` times.
SPLIT_OVER, SPLITS = 5_000_000, 2
#: Matching jobs that share the signatures among them.
SLICES = 4
#: Bits of the sketch that every set has; larger sets have a second one, a power of two of at least their size.
SKETCH_BITS = 64 * len(PARITY)


@dataclass(frozen=True)
class Rule:
    """Link when per_cent * |union| <= 100 * |intersection|; shingles of `words` words."""

    words: int = 4
    per_cent: int = 85

    def most_apart(self, l, m):
        """Greatest |A minus B| + |B minus A| of linked sets of these sizes."""
        return l + m - 2 * -(-self.per_cent * (l + m) // (100 + self.per_cent))

    def linked(self, l: int, m: int, both: int) -> bool:
        return bool(both) and 100 * both >= self.per_cent * (l + m - both)


@lru_cache(maxsize=1)
def bands() -> tuple[np.ndarray, ...]:
    """Of each band: greatest k served, n1, n2, partitions given beyond those that may differ."""
    rows = [(2 * n - 1, n, 3, 1) for n in (1, 2, 3, 4, 6, 8, 11, 15, 20, 26)]
    n = 64.0
    while n < 2**31:
        sure = 5 + int(n) // 25
        rows.append((int(n) - sure, int(n), 1, sure))
        n *= 2**0.5
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))


def _cut(buf: np.ndarray, offsets: np.ndarray, key: int, seeds: int = 1) -> X.Words:
    return X.strong(X.cut(buf, offsets, X.BLANK_WORDS_LOWER, seeds=0), key, seeds)


def _sets(words: X.Words, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(document, shingle hash) sorted and distinct, each document's first place, and the distinct shingles' hash by each seed."""
    docs = len(words.bounds) - 1
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < q))
    every = []
    for seed in range(len(words.hashes)):
        first, h = X.windows(words, q, seed)
        if len(short):
            h = np.concatenate((h, X.spans_hash(words, words.bounds[short], words.bounds[short + 1], seed) ^ X.U64(0x5851F42D4C957F2D)))
        every.append(h)
    doc = words.doc[first] if len(first) else np.empty(0, dtype=np.int64)
    doc = np.concatenate((doc, short))
    order = np.lexsort((every[0], doc))
    doc, h = doc[order], every[0][order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new], np.searchsorted(doc[new], np.arange(docs + 1)), [x[order][new] for x in every]


def _sums(slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Exact sums modulo 2 ** 64 by slot (halves add up exactly as doubles for under 2 ** 21 terms)."""
    low = np.bincount(slot, weights=(value & X.U64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(slot, weights=(value >> X.U64(32)).astype(np.float64), minlength=n)
    return (high.astype(np.uint64) << X.U64(32)) + low.astype(np.uint64)


def signatures(doc: np.ndarray, h: np.ndarray, bounds: np.ndarray, rule: Rule, family: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature) of one family, and the documents that need the next family."""
    caps, n1s, n2s, sures = bands()
    size = np.diff(bounds)
    least = rule.most_apart(size, -(-rule.per_cent * size // 100))
    most = rule.most_apart(size, 100 * size // rule.per_cent)
    live = np.flatnonzero(most > 0)
    low, high = np.searchsorted(caps, np.maximum(least[live], 1)), np.searchsorted(caps, most[live])
    reach = high - low + 1
    own = np.repeat(live, reach)
    band = np.repeat(low, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    if not len(own):
        return own, np.empty(0, dtype=np.uint64), own
    n1, n2 = n1s[band], n2s[band]
    parts = n1 * n2
    base = np.cumsum(parts) - parts
    n = size[own]
    at = np.repeat(np.arange(len(own)), n)
    element = h[np.repeat(bounds[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    spread = X.mix(element ^ X.U64(0x632BE59BD9B4E019 * (family + 1) & (2**64 - 1)))
    slot = base[at] + ((spread >> X.U64(32)) * parts[at].astype(np.uint64) >> X.U64(32)).astype(np.int64)
    total = int(parts.sum())
    content = _sums(slot, X.mix(element + X.U64(family + 1)), total)
    filled = np.bincount(slot, minlength=total) > 0
    # Parts of one partition lie side by side.
    k = np.minimum(caps[band], most[own])
    give = np.where(n2 == 3, k // 2, k) + sures[band]
    inst = np.repeat(np.arange(len(own)), parts)
    given = (np.arange(total) - base[inst]) // n2[inst] < give[inst]
    trio = n2[inst] == 3
    a = np.flatnonzero(~trio & given)
    b = np.flatnonzero(trio & given)[::3]
    sig_inst = np.concatenate((inst[a], inst[b], inst[b], inst[b]))
    where = np.concatenate((a - base[inst[a]], *(3 * (b - base[inst[b]]) + x for x in range(3))))
    pair = lambda x, y: X.mix(content[b + x] + X.U64(0x9E3779B97F4A7C15)) + X.mix(content[b + y] ^ X.U64(0xA0761D6478BD642F))
    body = np.concatenate((content[a], pair(0, 1), pair(1, 2), pair(0, 2)))
    some = np.concatenate((filled[a], filled[b] | filled[b + 1], filled[b + 1] | filled[b + 2], filled[b] | filled[b + 2]))
    tag = (band[sig_inst] * FAMILIES + family).astype(np.uint64) << X.U64(48)
    sig = X.mix(body ^ X.mix(tag + where.astype(np.uint64)))
    # Partitions that an empty signature could stand for, against those that are sure to agree.
    empty = np.bincount(inst[a[~filled[a]]], minlength=len(own)) + np.bincount(inst[b[(filled[b].astype(int) + filled[b + 1] + filled[b + 2]) < 2]], minlength=len(own))
    sparse = np.unique(own[empty >= sures[band]])
    use = np.ones(len(sig), dtype=bool) if last else some
    return own[sig_inst[use]], sig[use], sparse


def _read(docs: DataFrame, step, schema: str) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(step, schema)


def _wide(h: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each set its wide sketch and that folded to half, as lists of longs; null where the common sketch is wide enough."""
    full: list[np.ndarray | None] = [None] * (len(bounds) - 1)
    half: list[np.ndarray | None] = list(full)
    for d in np.flatnonzero(np.diff(bounds) > SKETCH_BITS).tolist():
        own = h[bounds[d] : bounds[d + 1]]
        bits = 1 << int(len(own) - 1).bit_length()
        odd = (np.bincount((own & X.U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
        full[d] = np.packbits(odd).view(np.int64)
        half[d] = np.packbits(odd[: bits // 2] ^ odd[bits // 2 :]).view(np.int64)
    return pa.array(full, pa.list_(pa.int64())), pa.array(half, pa.list_(pa.int64()))


def set_rows(docs: DataFrame, rule: Rule, key: int) -> DataFrame:
    """doc_id, n (set size), a 128-bit digest of the set (d1, d2) and its parity sketches."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in X.chunks(batch.column(1)):
                doc, h, bounds, both = _sets(_cut(buf, offsets, key, 2), rule.words)
                n = hi - lo
                d1, d2 = (_sums(doc, X.mix(x ^ X.U64(c)), n) for x, c in zip(both, (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35), strict=True))
                spread = X.mix(h + X.U64(0x27D4EB2F165667C5))
                odd = (np.bincount(doc * SKETCH_BITS + (spread & X.U64(SKETCH_BITS - 1)).astype(np.int64), minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
                sketch = np.packbits(odd).view(np.int64).reshape(n, len(PARITY))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(bounds)), pa.array(X.signed(d1)), pa.array(X.signed(d2)), *(pa.array(sketch[:, i]) for i in range(len(PARITY))), *_wide(spread, bounds)], names=["doc_id", "n", "d1", "d2", *SKETCH])

    return _read(docs, step, "doc_id long, n long, d1 long, d2 long, " + ", ".join(f"{p} long" for p in PARITY) + ", wide array<long>, folded array<long>")


def signature_rows(docs: DataFrame, rule: Rule, key: int, families: tuple[int, ...] = tuple(range(FAMILIES))) -> DataFrame:
    """sig, doc_id."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _hi, buf, offsets in X.chunks(batch.column(1)):
                doc, h, bounds, _ = _sets(_cut(buf, offsets, key), rule.words)
                origin = np.arange(len(bounds) - 1)
                for f in families:
                    own, sig, sparse = signatures(doc, h, bounds, rule, f, f == families[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(X.signed(sig)), pa.array(ids[lo + origin[own]])], names=["sig", "doc_id"])
                    if not len(sparse):
                        break
                    # Go on with the sparse documents alone.
                    stay = np.isin(doc, sparse)
                    origin, doc, h = origin[sparse], np.searchsorted(sparse, doc[stay]), h[stay]
                    bounds = np.searchsorted(doc, np.arange(len(sparse) + 1))

    return _read(docs, step, "sig long, doc_id long")


def _verify(rule: Rule, key: int):
    def one(text: pa.Scalar) -> np.ndarray:
        data = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)
        return _sets(_cut(data, np.array([0, len(data)]), key), rule.words)[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, None
            for k in range(batch.num_rows):
                # Pairs come in runs of one u.
                if held is None or batch.column(2)[k] != last:
                    last = batch.column(2)[k]
                    held = one(last)
                sets = held, one(batch.column(3)[k])
                both = len(np.intersect1d(*sets, assume_unique=True))
                if rule.linked(len(sets[0]), len(sets[1]), both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["u", "v"])

    return step


def _may_link(rule: Rule, a: str, b: str) -> Column:
    """Sketches of nodes (columns with prefixes a and b) differ in no more places than linked sets can."""
    most = F.col(a + "n") + F.col(b + "n") - 2 * F.expr(f"({rule.per_cent} * ({a}n + {b}n) + {99 + rule.per_cent}) div {100 + rule.per_cent}")
    apart = sum((F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in PARITY), F.lit(0))

    def near(x: str, y: str) -> Column:
        odd = F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j)))
        return F.aggregate(odd, F.lit(0), lambda total, i: total + i) <= most

    size = lambda side: F.coalesce(F.array_size(side + "wide"), F.lit(0))
    # Sets that may link differ in their sketches' sizes by one step at most, or else the common sketch alone decides.
    wide = F.when((size(a) == 0) | (size(b) == 0), True).when(size(a) == size(b), near(a + "wide", b + "wide")).when(size(a) == 2 * size(b), near(a + "folded", b + "wide")).when(2 * size(a) == size(b), near(a + "wide", b + "folded")).otherwise(True)
    return (apart <= most) & wide


def _prefixed(nodes: DataFrame, key: str, prefix: str) -> DataFrame:
    return nodes.select(F.col("node").alias(key), *(F.col(c).alias(prefix + c) for c in ("n", *SKETCH)))


def _plausible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    near = pairs.join(_prefixed(nodes, "u", "a_"), "u").join(_prefixed(nodes, "v", "b_"), "v").filter(_may_link(rule, "a_", "b_"))
    return near.select(*pairs.columns)


def _links(pairs: DataFrame, texts: DataFrame, rule: Rule, key: int) -> DataFrame:
    """The pairs (u, v) whose texts link."""
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("tb"))
    # First the side that recurs least; the text of a pivot joins last, and isn't shuffled once for each of its pairs.
    return pairs.select("u", "v").join(b, "v").join(a, "u").select("u", "v", "ta", "tb").mapInArrow(_verify(rule, key), "u long, v long").distinct()


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """sig, node, comp, main, cost of the signatures with more than one component."""
    own = members.join(comp, members["node"] == comp["cnode"], "left").select("sig", "node", F.coalesce("component", "node").alias("comp"))
    sizes = own.groupBy("sig", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("sig").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    return own.join(main, "sig").select("sig", "node", "comp", "main", (F.col("all") * (F.col("all") - F.col("top"))).alias("cost"))


def _cross(mixed: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (u, v) of one signature in different components, one of them outside the main one, that may link."""
    out = mixed.filter("comp != main").select("sig", F.col("node").alias("x"), F.col("comp").alias("cx")).join(_prefixed(nodes, "x", "a_"), "x")
    other = mixed.select("sig", F.col("node").alias("y"), F.col("comp").alias("cy"), "main").join(_prefixed(nodes, "y", "b_"), "y")
    apart = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y")))
    met = out.join(other, (out["sig"] == other["sig"]) & apart & _may_link(rule, "a_", "b_"))
    return met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def join(docs: DataFrame, work: str, rule: Rule = Rule(), split_over: int = SPLIT_OVER) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id of each row; verified links between class representatives).

    The links connect what is linked; they don't list every linked pair.
    """
    spark = docs.sparkSession
    key = secrets.randbits(63)
    sets = written(set_rows(docs, rule, key), f"{work}/sets")
    classes = sets.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), *(F.first(p).alias(p) for p in SKETCH))
    nodes = written(classes, f"{work}/classes")
    of_doc = written(sets.join(nodes.select("n", "d1", "d2", "node"), ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")), f"{work}/of_doc")
    by_doc = of_doc.select("doc_id", "node").distinct()

    # Partial aggregates find the signatures that are shared; equi-joins, which can split a hot one, take the rows back.
    every = written(signature_rows(docs, rule, key), f"{work}/signatures")
    for s in range(SLICES):
        rows = every.filter(F.pmod("sig", F.lit(SLICES)) == s)
        shared = rows.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("sig")
        written(rows.join(shared, "sig", "left_semi").join(by_doc, "doc_id").select("sig", "node").distinct(), f"{work}/met/slice={s}")
    remove(spark, f"{work}/signatures")
    met = spark.read.schema("sig long, node long").parquet(f"{work}/met")
    pivots = met.groupBy("sig").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot < top").select("sig", "pivot")
    members = written(met.join(pivots, "sig").select("sig", "node", "pivot"), f"{work}/members")

    stars = members.filter("pivot != node").groupBy(F.col("pivot").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("shared"))
    # A node that only ever is a pivot has partners of its own among v; all are met again below.
    plausible = _plausible(stars, nodes, rule)
    best = written(plausible.groupBy("v").agg(F.max_by("u", F.struct("shared", -F.col("u"))).alias("u")).select("u", "v"), f"{work}/best")
    involved = members.select("node").distinct()
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), "text").join(involved, "node")
    # Repeated rows would meet each other in every pair.
    texts = written(texts.withColumn("same", F.xxhash64("text")).dropDuplicates(["node", "same"]).drop("same"), f"{work}/texts")
    links = written(_links(best, texts, rule, key), f"{work}/links-1")

    comp = components(links, f"{work}/comp-1").select(F.col("node").alias("cnode"), "component")
    mixed = written(_mixed(members.select("sig", "node"), comp), f"{work}/mixed-0")
    pairs = _cross(mixed.filter(F.col("cost") <= split_over), nodes, rule)
    for s in range(1, SPLITS + 1):
        hot = mixed.filter(F.col("cost") > split_over).select("sig", "node")
        if hot.isEmpty():
            break
        again = texts.join(hot.select("node").distinct(), "node").select(F.col("node").alias("doc_id"), "text")
        more = signature_rows(again, rule, key, tuple(range(FAMILIES + 4 * s, 2 * FAMILIES + 4 * s))).select(F.col("sig").alias("next"), F.col("doc_id").alias("node"))
        hot = hot.join(more, "node").select(F.xxhash64("sig", "next").alias("sig"), "node").distinct()
        mixed = written(_mixed(hot, comp), f"{work}/mixed-{s}")
        pairs = pairs.unionByName(_cross(mixed.filter(F.col("cost") <= split_over) if s < SPLITS else mixed, nodes, rule))
    tried = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = written(pairs.distinct().join(tried, ["u", "v"], "left_anti"), f"{work}/pairs")
    links = links.unionByName(written(_links(pairs, texts, rule, key), f"{work}/links-2"))
    for name in ("sets", "classes", "met", "members", "best", "texts", "comp-1", "pairs", *(f"mixed-{s}" for s in range(SPLITS + 1))):
        remove(spark, f"{work}/{name}")
    # Rows of one doc_id with different sets are one node.
    same = by_doc.filter("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    doubled = of_doc.groupBy("doc_id").agg(F.countDistinct("node").alias("nodes")).filter("nodes > 1").select(F.col("doc_id").alias("u"))
    final = components(links.unionByName(same.join(doubled, "u", "left_semi")), f"{work}/comp-2")
    found = of_doc.join(final.withColumnRenamed("node", "cnode"), F.col("node") == F.col("cnode"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    without = docs.filter(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(without), links


def keep_one(docs: DataFrame, work: str, rule: Rule) -> DataFrame:
    """docs with one document of each component, the one of least doc_id; rows without a doc_id stay."""
    found, _ = join(docs, work, rule)
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), shared_dir(spark))[0]


def brute(docs: list[tuple[int, str | None]], rule: Rule = Rule()) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), all pairs; for tests on small inputs."""
    import re

    sets = {}
    for i, t in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[a : a + rule.words]) for a in range(len(w) - rule.words + 1)} if len(w) >= rule.words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and rule.linked(len(x), len(y), len(x & y)):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
ln AS (SELECT u, v FROM pr JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
ed AS (SELECT u, v FROM ln UNION ALL SELECT v, u FROM ln),
rc AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT ed.u, rc.r FROM ed JOIN rc ON rc.u = ed.v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN rc ON rc.u = d.doc_id GROUP BY d.doc_id, n
"""
