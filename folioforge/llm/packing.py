"""Best-fit packing of token pieces into sequences, by local search between underfull bins.

Pieces are dealt at random into groups of bounded size that are packed side by
side.  Each group starts from best fit in order of arrival, which leaves a few
bins too many, and a local search then empties bins, the emptiest first.  Its
steps move a piece, or exchange one for one, two for one or one for two, always
from the emptier to the fuller bin, so each step increases the sum of squared
fills and the search ends.  It goes on until the bins are as few as the tokens
allow, or a pass that tried every underfull bin made no step; then it tries
again from best fit in order of falling length, and the better of both stays.

Groups lose up to a bin each.  Bins whose room is above the mean room of their
group's underfull bins are opened and their pieces dealt again into fewer
groups.  It ends when one group is left, when the bins are as few as the tokens
allow, or when a round saves no bin; so it ends on pieces that fit together
nowhere, too.

Defined results: null text is empty; an empty text is one piece that holds the
end token alone; rows of equal doc_id or equal text are separate pieces; an
empty table gives no rows; a null doc_id is carried through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_dir, table, written
from .tokens import END_ID, default_tokenizer, held

CAPACITY = 4096
GROUP_PIECES = 16_384

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES: the documents' ids with the end id, cut only where longer than `capacity`."""
    path = tokenizer or default_tokenizer()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(path)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(text.as_py() or ""), END_ID).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, x in zip(out, (doc_id, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(step, PIECES)


def best_fit(lengths: list[int], capacity: int, order: Iterable[int] | None = None) -> list[list[int]]:
    """Bins of piece numbers: in the order given (else longest first), each into the fullest bin that has room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)) if order is None else order:
        n = lengths[i]
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


class _Search:
    """Local search over bins; the pieces of all bins are looked at together."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity = capacity
        self.length = np.array(lengths, np.int64)
        self.bin = np.empty(len(lengths), np.int64)
        for b, own in enumerate(bins):
            self.bin[own] = b
        self.fill = np.bincount(self.bin, weights=self.length, minlength=len(bins)).astype(np.int64)
        self.steps = {"move": 0, "one for one": 0, "two for one": 0, "one for two": 0}
        self.emptied = 0

    def _shift(self, kind: str, a: int, give: list[int], b: int, take: list[int]) -> None:
        gain = int(self.length[give].sum() - self.length[take].sum())
        self.bin[give], self.bin[take] = b, a
        self.fill[a] -= gain
        self.fill[b] += gain
        self.steps[kind] += 1

    def _pairs(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each two pieces of one bin; pieces are sorted by bin."""
        of = self.bin[pieces]
        first, second, k = [], [], 1
        while k < len(pieces) and len(at := np.flatnonzero(of[k:] == of[:-k])):
            first.append(pieces[at])
            second.append(pieces[at + k])
            k += 1
        empty = np.empty(0, np.int64)
        return np.concatenate(first or [empty]), np.concatenate(second or [empty])

    def _step(self, a: int, others: np.ndarray) -> bool:
        """One step from bin a to one of the others (pieces of bins at least as full, sorted by bin): of the first kind that can, the one that moves most."""
        own = np.flatnonzero(self.bin == a)
        room = self.capacity - self.fill
        room[self.fill < self.fill[a]] = 0
        room[a] = 0
        fits = own[self.length[own] <= room.max()]
        if len(fits):
            x = fits[np.argmax(self.length[fits])]
            # Best fit: of the bins that can take it the fullest.
            b = np.where(room >= self.length[x], room, self.capacity + 1).argmin()
            self._shift("move", a, [x], int(b), [])
            return True
        others = others[(self.bin[others] != a) & (room[self.bin[others]] > 0)]
        if not len(others):
            return False
        length, space = self.length[others], room[self.bin[others]]

        def best(gains: np.ndarray, space: np.ndarray) -> tuple[int, int] | None:
            ok = np.where((gains > 0) & (gains <= space), gains, 0)
            at = int(ok.argmax())
            return divmod(at, ok.shape[1]) if ok.flat[at] else None

        found = best(self.length[own][:, None] - length[None], space[None])
        if found:
            y = others[found[1]]
            self._shift("one for one", a, [own[found[0]]], int(self.bin[y]), [y])
            return True
        i, j = np.triu_indices(len(own), 1)
        for lo in range(0, len(i), 64):  # a bin of very many small pieces: a block of pairs at a time
            u, v = own[i[lo : lo + 64]], own[j[lo : lo + 64]]
            found = best((self.length[u] + self.length[v])[:, None] - length[None], space[None])
            if found:
                y = others[found[1]]
                self._shift("two for one", a, [u[found[0]], v[found[0]]], int(self.bin[y]), [y])
                return True
        u, v = self._pairs(others)
        if len(u):
            both, space = self.length[u] + self.length[v], room[self.bin[u]]
            for x in own:
                found = best(self.length[x] - both[None], space[None])
                if found:
                    y, z = u[found[1]], v[found[1]]
                    self._shift("one for two", a, [x], int(self.bin[y]), [y, z])
                    return True
        return False

    def run(self) -> list[list[int]]:
        fewest = -(-int(self.fill.sum()) // self.capacity)
        alive = int((self.fill > 0).sum())
        while alive > fewest:
            before = sum(self.steps.values())
            underfull = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            for a in underfull[np.argsort(self.fill[underfull], kind="stable")].tolist():
                if alive <= fewest:
                    break
                if not 0 < self.fill[a] < self.capacity:
                    continue
                others = np.flatnonzero(self.fill[self.bin] < self.capacity)
                others = others[np.argsort(self.bin[others], kind="stable")]
                tries = 0
                while self.fill[a] and self._step(a, others):
                    tries += 1
                    if tries % 64 == 0:  # full bins fall away
                        others = np.flatnonzero(self.fill[self.bin] < self.capacity)
                        others = others[np.argsort(self.bin[others], kind="stable")]
                if not self.fill[a]:
                    alive -= 1
                    self.emptied += 1
            if sum(self.steps.values()) == before:
                break
        order = np.argsort(self.bin, kind="stable")
        return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(self.bin[order])) + 1)] if len(order) else []


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[list[int]], int, int]:
    """(bins of piece numbers, steps, emptied bins of the search that made them)."""
    fewest = -(-sum(lengths) // capacity)
    best: tuple[list[list[int]], int, int] | None = None
    for order in (range(len(lengths)), None):
        search = _Search(best_fit(lengths, capacity, order), lengths, capacity)
        bins = search.run()
        if best is None or len(bins) < len(best[0]):
            best = bins, sum(search.steps.values()), search.emptied
        if len(bins) <= fewest:
            break
    return best


PACKED = PIECES + ", uid long, sequence_id long, offset long, loose boolean, steps long, emptied long"


def _pack(first: int, capacity: int):
    """first: groups of the rounds before, so sequence numbers differ between rounds."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        lengths = group["length"].tolist()
        bins, steps, emptied = pack_group(lengths, capacity)
        order = [i for b in bins for i in b]
        sizes = [len(b) for b in bins]
        out = group.iloc[order].reset_index(drop=True)
        number = np.repeat(np.arange(len(bins)), sizes)
        base = (first + int(group["grp"].iloc[0])) << 24
        out["sequence_id"] = base + number
        before = out["length"].cumsum() - out["length"]
        out["offset"] = before - before.groupby(number).transform("first")
        room = capacity - np.bincount(number, weights=out["length"], minlength=len(bins))
        under = room[room > 0]
        out["loose"] = (room > (under.mean() if len(under) else 0))[number]
        out["steps"], out["emptied"] = steps, emptied
        return out.drop(columns="grp")

    return one


def pack(found: DataFrame, work: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """found (PIECES) with sequence_id, offset, and of the group that packed the piece the steps of its search and the bins that it emptied."""
    rest = written(found.withColumn("uid", F.monotonically_increasing_id()), f"{work}/pieces")
    none = F.lit(0).cast("long")
    done = rest.filter(F.col("length") == capacity).select("*", (F.lit(-1) - F.col("uid")).alias("sequence_id"), none.alias("offset"), none.alias("steps"), none.alias("emptied")).drop("uid")
    rest = rest.filter(F.col("length") < capacity)
    opened, bins, first, r = None, 0, 0, 1
    while True:
        n, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = -(-n // group_pieces) or 1
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(groups)))
        packed = written(dealt.groupBy("grp").applyInPandas(_pack(first, capacity), PACKED), f"{work}/packed-{r}")
        # Each bin has one piece at offset 0.
        starts = F.col("offset") == 0
        now, left = packed.agg(F.count_if(starts), F.count_if(starts & F.col("loose"))).first()
        if opened is not None and now >= bins:
            return done.unionByName(opened.drop("uid", "loose"))
        if groups == 1 or now <= -(-tokens // capacity):
            return done.unionByName(packed.drop("uid", "loose"))
        done = done.unionByName(packed.filter(~F.col("loose")).drop("uid", "loose"))
        opened, bins = packed.filter("loose"), left
        rest = opened.drop("sequence_id", "offset", "loose", "steps", "emptied")
        first += groups
        r += 1


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(table(spark, sf_dir, "documents"))
    return pack(found, shared_dir(spark)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "steps", "emptied")
