"""One record per edition, and the order of what is left, within each query.

Both steps depend on the order of candidates (provider position, then item
position), and ranking is not transitive, so they run query by query over its
few candidates: one shuffle on query_id, a sort within partitions, and one pass
of Arrow batches that takes the runs of equal query_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import alnum_key
from .scoring import provider_rank

#: Sources of audio covers; the band within which confidence does not rank.
AUDIO_SOURCES = ("audible", "apple", "storytel")
TIE, EPS = 0.1, 1e-9

CANDIDATE = (
    "query_id long, provider string, provider_pos int, item_pos int, id string, asin string, title string, authors array<string>, narrators array<string>,"
    " audio_seconds double, cover string, language string, confidence double, delta double, pinned boolean, junk boolean, bundle boolean, language_conflict boolean, narrator_match boolean"
)
RANKED = CANDIDATE + ", position int, members int"


def with_keys(df: DataFrame) -> DataFrame:
    """Adds identity keys: by store id, by running time, or by title where there is neither."""
    who = F.concat_ws("|", alnum_key(F.col("title")), alnum_key(F.get("authors", F.lit(0))))
    asin = F.when(F.coalesce(F.col("asin"), F.lit("")) != "", F.concat(F.lit("asin:"), F.upper("asin")))
    dur = F.when(F.col("audio_seconds").isNotNull(), F.concat(F.lit("dur:"), who, F.lit("|"), F.round(F.col("audio_seconds") / 60).cast("long").cast("string")))
    book = F.when(asin.isNull() & dur.isNull(), F.concat(F.lit("book:"), who))
    return df.withColumn("keys", F.filter(F.array(asin, dur, book), lambda k: k.isNotNull()))


class _Clusters:
    """Disjoint sets of candidate numbers, each with the languages known in it."""

    def __init__(self):
        self.of: dict[int, int] = {}
        self.members: dict[int, list[int]] = {}
        self.languages: dict[int, set[str]] = {}

    def add(self, i: int, language: str | None) -> None:
        self.of[i], self.members[i], self.languages[i] = i, [i], {language} if language else set()

    def may_meet(self, i: int, j: int) -> bool:
        a, b = self.of[i], self.of[j]
        return a == b or not self.languages[a] or not self.languages[b] or len(self.languages[a] | self.languages[b]) == 1

    def merge(self, i: int, j: int) -> None:
        small, large = sorted((self.of[i], self.of[j]), key=lambda c: len(self.members[c]))
        if small == large:
            return
        for m in self.members[small]:
            self.of[m] = large
        self.members[large] += self.members.pop(small)
        self.languages[large] |= self.languages.pop(small)


def _clusters(rows: list[dict]) -> list[list[int]]:
    """Members of each edition in order of their first member."""
    sets = _Clusters()
    holders: dict[str, list[int]] = {}
    for i, row in enumerate(rows):
        sets.add(i, row["language"])
        for key in row["keys"]:
            earlier = holders.setdefault(key, [])
            # A store id always means the same edition; other keys only where known languages agree.
            partner = earlier[0] if earlier and key.startswith("asin:") else next((j for j in earlier if sets.may_meet(i, j)), None)
            if partner is not None:
                sets.merge(i, partner)
            earlier.append(i)
    return sorted((sorted(m) for m in sets.members.values()), key=lambda m: m[0])


def _audio_cover(row: dict) -> bool:
    return bool(row["cover"]) and (row["provider"] in AUDIO_SOURCES or bool(row["asin"]) or row["audio_seconds"] is not None)


def _merged(members: list[dict]) -> dict:
    """The edition's record: its best member, with what that lacks from the others."""
    full = lambda r: bool(r["asin"]) + (r["audio_seconds"] is not None) + bool(r["narrators"]) + bool(r["cover"])
    by_worth = sorted(members, key=lambda r: (-r["confidence"], -full(r)))
    best = min(by_worth, key=lambda r: (not (r["pinned"] and not r["junk"]), r["junk"]))
    sound = [r for r in by_worth if not r["junk"]]
    out = dict(best)
    if not out["asin"]:
        out["asin"] = next((r["asin"] for r in sound if r["asin"]), out["asin"])
    if not out["narrators"]:
        out["narrators"] = next((r["narrators"] for r in sound if r["narrators"]), out["narrators"])
    if not _audio_cover(best):
        spoken = next((r["cover"] for r in by_worth if _audio_cover(r)), None)
        out["cover"] = spoken or out["cover"] or next((r["cover"] for r in by_worth if r["cover"]), None)
    out["members"] = len(members)
    return out


def _before(a: dict, b: dict) -> int:
    """Negative if a ranks above b; the first rule that tells them apart decides."""
    for rule in (lambda r: r["pinned"] and not r["bundle"] and not r["junk"],):
        if rule(a) != rule(b):
            return -1 if rule(a) else 1
    gap = a["confidence"] - b["confidence"]
    if abs(gap) > TIE:
        return -1 if gap > 0 else 1
    for rule in (
        lambda r: not r["language_conflict"],
        lambda r: (r["audio_seconds"] or 0) > 0 or bool(r["narrators"]),
        lambda r: r["narrator_match"],
    ):
        if rule(a) != rule(b):
            return -1 if rule(a) else 1
    if a["delta"] is not None and b["delta"] is not None and abs(a["delta"] - b["delta"]) > EPS:
        return -1 if a["delta"] < b["delta"] else 1
    if abs(gap) > EPS:
        return -1 if gap > 0 else 1
    return a["rank"] - b["rank"]


_PARTS = [c.split()[0] for c in RANKED.split(", ")]


def _one_query(rows: list[dict]) -> list[dict]:
    """The ranked editions of one query's candidates, given in order."""
    for r in rows:
        for k in ("authors", "narrators", "keys"):
            r[k] = r[k] or []
    merged = [_merged([rows[i] for i in m]) for m in _clusters(rows)]
    ordered = sorted(merged, key=cmp_to_key(_before))
    for k, r in enumerate(ordered):
        r["position"] = k
    return ordered


def _run_by_run(schema: pa.Schema):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last run of a batch may go on in the next.
        open_: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                if open_ and row["query_id"] != open_[0]["query_id"]:
                    done += _one_query(open_)
                    open_ = []
                open_.append(row)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in _PARTS} for r in done], schema=schema)
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in _PARTS} for r in _one_query(open_)] if open_ else [], schema=schema)

    return step


def dedupe_and_rank(candidates: DataFrame) -> DataFrame:
    """candidates (CANDIDATE) with one row per edition and its position in the ranking: RANKED."""
    ready = with_keys(candidates).withColumn("rank", provider_rank(F.col("provider")))
    dealt = ready.repartition("query_id").sortWithinPartitions("query_id", "provider_pos", "item_pos")
    return dealt.mapInArrow(_run_by_run(to_arrow_schema(StructType.fromDDL(RANKED))), RANKED)
