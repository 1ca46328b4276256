"""Exact range join of embeddings, and its connected components.

Cosine of at least `least` is a chord of at most r = sqrt(2 - 2 * least) between
the unit vectors, a metric.  Pivots (centres found on a bounded sample) partition
the vectors: a vector's cell is that of its nearest pivot.  A vector must also be
looked at in every cell that may hold one within r of it; by the triangle
inequality a cell is ruled out where

    |x - pivot| > |x - own pivot| + 2 r      (its members are nearer to their pivot)
    |x - pivot| > radius of the cell + r
    x lies further than r beyond the plane between both pivots

and x is copied to all others.  Cells then join by themselves, and since every
partner of a cell's own vectors is there, their counts of links are complete.

A cell of many own vectors is divided into units of at most about BLOCK of them;
a unit holds its own in memory and lets the others stream past in order of their
distance to the pivot, so that only own vectors within r of that distance are
compared.  Products are taken in single precision; what lies within their error
bound of the threshold is decided in double precision.  A unit gives one row for
each vector that has a link in it, never the pairs: counts of links, and stars
that connect what is linked.

Equal vectors are one node with a number of copies.  Where vectors spread evenly
in many dimensions no pivot rules anything out, and the join is one of blocks:
n * n / BLOCK rows are copied.  It is exact all the same.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing, nor do vectors of different lengths link; a null
vec_id links with nothing, and its component is null; rows of one vec_id are one
vector, the one of least digest where they differ, and get equal results; an
empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import shared_dir, table, written

LEAST = 0.9
#: Own vectors of a unit at most; pivots at most, and bytes of vectors they are found on.
BLOCK, PIVOTS, SAMPLE_BYTES = 4096, 1024, 16 << 20
#: Units that a table too small for full ones is dealt into, and own vectors of a unit at least.
UNITS, LEAST_BLOCK = 32, 256
STREAM = 1024
#: Room for rounding in distances.
SLACK = 1e-6


def vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, dim, d1, d2 (128 bits of BLAKE2b), vec (its bytes) of the vectors that can link."""
    single = df.schema[vector].dataType == T.ArrayType(T.FloatType(), True) or df.schema[vector].dataType == T.ArrayType(T.FloatType(), False)
    kind = np.float32 if single else np.float64

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            good = np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            whole = lambda x: np.concatenate(([0], np.cumsum(x)))
            bad, set_ = whole(~good), whole(value != 0)
            use = (size > 0) & (bad[ends] == bad[ends - size]) & (set_[ends] > set_[ends - size]) & lists.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(use)
            body = [value[e - n : e].tobytes() for e, n in zip(ends[at].tolist(), size[at].tolist(), strict=True)]
            digest = np.frombuffer(b"".join(blake2b(b, digest_size=16).digest() for b in body), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(size[at], pa.int32()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(body, pa.binary())], names=["vec_id", "dim", "d1", "d2", "vec"])

    ids = F.col("vec_id").cast("long").alias("vec_id")
    return df.filter(F.col("vec_id").isNotNull()).select(ids, F.col(vector).cast(T.ArrayType(T.FloatType() if single else T.DoubleType()))).mapInArrow(step, "vec_id long, dim int, d1 long, d2 long, vec binary")


def units_of(body: pa.Array, dim: int, kind) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    raw = b"".join(x.as_buffer() for x in body)
    x = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit vectors near which those of x gather."""
    p = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds if k > 1 else 0):
        own = np.argmax(x @ p.T, axis=1)
        total = np.zeros_like(p)
        np.add.at(total, own, x)
        length = np.sqrt(np.einsum("ij,ij->i", total, total))
        p[length > 0] = total[length > 0] / length[length > 0, None]
    return p


def pivots(nodes: DataFrame, count: int, block: int, kind) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, in proportion to the sample; the sample is the vectors of least digest, within SAMPLE_BYTES."""
    k = min(PIVOTS, -(-count // block))
    width = nodes.agg(F.max(F.octet_length("vec"))).first()[0] or 1
    rows = nodes.select("dim", "vec").orderBy("d1", "d2").limit(max(1, min(16 * k, SAMPLE_BYTES // width))).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in rows:
        by_dim.setdefault(r["dim"], []).append(bytes(r["vec"]))
    return {dim: centres(units_of(pa.array(own, pa.binary()), dim, kind), max(1, min(len(own), k * len(own) // len(rows)))) for dim, own in by_dim.items()}


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


class Cells:
    """The partition by pivots: cells are numbered through all lengths; a length outside the sample is one cell of its own."""

    def __init__(self, found: dict[int, np.ndarray], kind):
        self.pivots, self.kind, self.first = found, kind, {}
        n = 0
        for dim in sorted(found):
            self.first[dim] = n
            n += len(found[dim])

    def assign(self, nodes: DataFrame) -> DataFrame:
        """node, copies, dim, vec, cell, near (distance to the cell's pivot)."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, part in _by_dim(batch):
                    cell, near = np.full(part.num_rows, -dim), np.zeros(part.num_rows)
                    if dim in self.first:
                        dot = units_of(part.column("vec"), dim, self.kind) @ self.pivots[dim].T
                        own = np.argmax(dot, axis=1)
                        cell, near = own + self.first[dim], _chord(dot[np.arange(len(own)), own])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(near)], names=[*part.schema.names, "cell", "near"])

        return nodes.select("node", "copies", "dim", "vec").mapInArrow(step, "node long, copies long, dim int, vec binary, cell int, near double")


def _chord(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * dot))


def reached(x: np.ndarray, pivot: np.ndarray, radius: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(may a cell hold a vector within r of each x, distances to the pivots)."""
    dot = x @ pivot.T
    far = _chord(dot)
    own = np.argmax(dot, axis=1)
    rows = np.arange(len(x))
    apart = _chord(pivot @ pivot.T)[own]
    may = (far <= far[rows, own][:, None] + 2 * r + SLACK) & (far <= radius + r + SLACK) & (dot[rows, own][:, None] - dot <= r * apart + SLACK)
    may[rows, own] = True
    return may, far


def replicated(assigned: DataFrame, cells: Cells, radius: dict[int, float], blocks: dict[int, int], r: float) -> DataFrame:
    """unit, own (0) or passing (1), near, node, copies, dim, vec: each vector in its own unit and to be looked at in every unit that it reaches."""
    first_unit, total = {}, 0
    for cell in sorted(blocks):
        first_unit[cell] = total
        total += blocks[cell]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                if dim in cells.first:
                    base, pivot = cells.first[dim], cells.pivots[dim]
                    names = [base + i for i in range(len(pivot))]
                else:
                    base, pivot, names = -dim, None, [-dim]
                unit0 = np.array([first_unit.get(c, 0) for c in names], np.int64)
                n = np.array([blocks.get(c, 0) for c in names], np.int64)
                size = np.array([radius.get(c, 0.0) for c in names])
                rows = max(1, (1 << 16) // max(1, int(n.sum())))
                for lo in range(0, part.num_rows, rows):
                    some = part.slice(lo, rows)
                    if pivot is None:
                        may, far = np.ones((some.num_rows, 1), bool), np.zeros((some.num_rows, 1))
                    else:
                        may, far = reached(units_of(some.column("vec"), dim, cells.kind), pivot, size, r)
                    i, j = np.nonzero(may)
                    k = n[j]
                    i, j = np.repeat(i, k), np.repeat(j, k)
                    unit = unit0[j] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
                    node, cell = some.column("node").to_numpy(), some.column("cell").to_numpy() - base
                    own = unit0[cell] + node % n[cell]
                    at = np.concatenate((np.arange(some.num_rows), i))
                    near = np.concatenate((some.column("near").to_numpy(), far[i, j]))
                    role = np.concatenate((np.zeros(some.num_rows, np.int32), np.ones(len(i), np.int32)))
                    take = some.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((own, unit)), pa.int32()), pa.array(role), pa.array(near), *(take.column(c) for c in ("node", "copies", "dim", "vec"))], names=["unit", "role", "near", "node", "copies", "dim", "vec"])

    return assigned.mapInArrow(step, "unit int, role int, near double, node long, copies long, dim int, vec binary")


class Unit:
    """Own vectors in memory, by distance to the pivot; others stream past in that order."""

    def __init__(self, dim: int, least: float, kind):
        self.dim, self.least, self.kind = dim, least, kind
        self.r = np.sqrt(2 - 2 * least)
        self.error = (dim + 8) * 2.0**-23
        self.parts: list[pa.RecordBatch] = []
        self.ready = False

    def own(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def _settle(self) -> None:
        whole = lambda c: np.concatenate([p.column(c).to_numpy() for p in self.parts]) if self.parts else np.empty(0, np.int64)
        self.node, self.near = whole("node"), whole("near").astype(np.float64)
        self.x = np.concatenate([units_of(p.column("vec"), self.dim, self.kind) for p in self.parts]) if self.parts else np.empty((0, self.dim))
        self.x32 = self.x.astype(np.float32)
        self.links, self.group = np.zeros(len(self.node)), np.arange(len(self.node))
        self.parts, self.ready = [], True

    def passing(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes others in; yields (node, a linked own node) of those that are linked."""
        if not self.ready:
            self._settle()
        if not len(self.node):
            return
        for lo in range(0, batch.num_rows, STREAM):
            some = batch.slice(lo, STREAM)
            near = some.column("near").to_numpy()
            a = int(np.searchsorted(self.near, near.min() - self.r - SLACK))
            b = int(np.searchsorted(self.near, near.max() + self.r + SLACK, side="right"))
            if a >= b:
                continue
            y = units_of(some.column("vec"), self.dim, self.kind)
            dot = y.astype(np.float32) @ self.x32[a:b].T
            j, i = np.nonzero(dot >= np.float32(self.least - self.error))
            close = np.flatnonzero(dot[j, i] < self.least + self.error)
            keep = np.ones(len(j), bool)
            keep[close] = np.einsum("ij,ij->i", y[j[close]], self.x[a:b][i[close]]) >= self.least
            node = some.column("node").to_numpy()
            i += a
            keep &= node[j] != self.node[i]
            j, i = j[keep], i[keep]
            if not len(j):
                continue
            self.links += np.bincount(i, weights=some.column("copies").to_numpy()[j], minlength=len(self.links))
            first = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1])))
            yield node[j[first]], self.node[i[first]]
            self._unite(np.repeat(i[first], np.diff(np.append(first, len(j)))), i)

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.group[a], self.group[b]
        apart = a != b
        for p, q in np.unique(np.stack((a[apart], b[apart]), axis=1), axis=0).tolist():
            p, q = self.group[p], self.group[q]
            if p != q:
                self.group[self.group == max(p, q)] = min(p, q)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """node, a node of its group, links of the own vectors that have any."""
        if not self.ready:
            self._settle()
        has = self.links > 0
        return self.node[has], self.node[self.group[has]], self.links[has].astype(np.int64)


def joined(rows: DataFrame, least: float, kind) -> DataFrame:
    """u, v, n: v is connected with u; n links are counted at u."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda u, v, n: pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])
        unit, number = None, None
        for batch in batches:
            of, role = batch.column("unit").to_numpy(), batch.column("role").to_numpy()
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if of[a] != number:
                    if unit is not None:
                        yield out(*unit.rows())
                    number, unit = of[a], Unit(batch.column("dim")[a].as_py(), least, kind)
                part = batch.slice(a, b - a)
                if role[a] == 0:
                    unit.own(part)
                else:
                    for u, v in unit.passing(part):
                        yield out(u, v, np.zeros(len(u), np.int64))
        if unit is not None:
            yield out(*unit.rows())

    return rows.repartition("unit").sortWithinPartitions("unit", "role", "near").mapInArrow(step, "u long, v long, n long")


def unit_size(count: int) -> int:
    return max(LEAST_BLOCK, min(BLOCK, -(-count // UNITS)))


def range_join(df: DataFrame, work: str, least: float = LEAST, vector: str = "embedding", block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each row of df."""
    kind = np.float32 if df.schema[vector].dataType.elementType == T.FloatType() else np.float64
    rows = written(vectors(df, vector), f"{work}/vectors")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("vec_id", "d.d1", "d.d2")
    of_id = written(one, f"{work}/of_id")
    classes = written(of_id.groupBy("d1", "d2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), f"{work}/classes")
    firsts = rows.join(classes.hint("merge"), ["d1", "d2"]).filter(F.col("vec_id") == F.col("node"))
    nodes = written(firsts.dropDuplicates(["node"]).select("node", "copies", "dim", "vec", "d1", "d2"), f"{work}/nodes")
    count = nodes.count()
    block = block or unit_size(count)
    cells = Cells(pivots(nodes, count, block, kind), kind)
    assigned = written(cells.assign(nodes), f"{work}/assigned")
    # A row for each pivot, and for each length of vectors.
    stats = {s["cell"]: s for s in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("radius")).collect()}
    dealt = replicated(assigned, cells, {c: s["radius"] for c, s in stats.items()}, {c: -(-s["n"] // block) for c, s in stats.items()}, float(np.sqrt(2 - 2 * least)))
    found = written(joined(dealt, least, kind), f"{work}/found")
    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    comp = components(found.filter("u != v").select("u", "v"), f"{work}/components")
    of_node = classes.join(links, F.col("node") == F.col("u"), "left").select("d1", "d2", "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    of_node = written(of_node.join(comp.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("component")), f"{work}/of_node")
    each = of_id.join(of_node.hint("merge"), ["d1", "d2"]).select(F.col("vec_id").alias("own"), "n", "component")
    ids = df.select(F.col("vec_id").cast("long").alias("vec_id"))
    component = F.coalesce("component", "vec_id")
    return ids.join(each, F.col("vec_id") == F.col("own"), "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"), shared_dir(spark))


def brute(rows: list[tuple[int | None, list | None]], least: float = LEAST) -> list[tuple]:
    """All pairs; for tests on small inputs without repeated ids."""
    unit = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float64)
            unit[i] = x / np.sqrt(x @ x)
    links = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least} for i in unit}
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            fresh = links.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        c = None if i is None else min(seen)
        out.append((i, len(links.get(i, ())), c, i is not None and c == i))
    return out


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ln AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
rc AS (SELECT vec_id AS u, vec_id AS r FROM embeddings UNION SELECT ln.u, rc.r FROM ln JOIN rc ON rc.u = ln.w),
n AS (SELECT u, count(*) AS n FROM ln GROUP BY u), c AS (SELECT u, min(r) AS c FROM rc GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id JOIN c ON c.u = vec_id
"""
