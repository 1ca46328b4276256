"""Lossless similarity join of strings by block matching: every pair whose ratio reaches a threshold.

ratio(a, b) >= t asks for M >= t * (n + m) / 2 matched characters, so

- lengths: the shorter has at least t / (2 - t) of the longer's characters;
- characters: the strings share at least M of them, as multisets;
- bigrams: matching blocks are parted by unmatched characters, of which there are
  n + m - 2 * M, so M characters lie in at most that many blocks and one more,
  and a block of s characters has s - 1 bigrams: the strings share at least
  (n + m) * (3 * t / 2 - 1) - 1 bigrams, as multisets.

Of a set that must share c tokens with another the first size - c + 1 in any
common order are enough to meet by.  Rare tokens come first in that order, so
strings meet in few places: bigrams where the bound gives any, characters for
what is too short for that (and for all where t is at most 2/3).  A meeting
place is a token and a band of lengths.  Pairs are let through by length and by
bits of character counts, which bound what two strings can share, all on the JVM
side; the few that are left are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio, title_forms
from ..sources.tables import cut_lineage

#: Characters whose counts are kept as bits, and how many of each; others don't bound anything.
COUNTED, BITS = "abcdefghijklmnopqrstuvwxyz0123456789 ", 6
_PER_LONG = 10
MASKS = [f"m{i}" for i in range(-(-len(COUNTED) // _PER_LONG))]


def count_bits(text: Column) -> dict[str, Column]:
    """MASKS: of each counted character as many bits as the text has of it, BITS at most."""
    out = {}
    for i, name in enumerate(MASKS):
        total = F.lit(0).cast("long")
        for k, ch in enumerate(COUNTED[i * _PER_LONG : (i + 1) * _PER_LONG]):
            n = F.char_length(text) - F.char_length(F.replace(text, F.lit(ch), F.lit("")))
            unary = F.element_at(F.array(*(F.lit((1 << b) - 1 << BITS * k) for b in range(BITS + 1))), F.least(n, F.lit(BITS)) + 1)
            total = total.bitwiseOR(unary.cast("long"))
        out[name] = total
    return out


def most_shared(a: str, b: str) -> Column:
    """No less than the characters that two strings (columns n and MASKS with prefixes) share."""
    without = lambda x, y: F.col(f"{x}n") - sum((F.bit_count(F.col(x + m).bitwiseAND(F.bitwise_not(F.col(y + m)))) for m in MASKS), F.lit(0))
    return F.least(without(a, b), without(b, a))


def least_partner(n: int, t: float) -> int:
    return math.ceil(n * t / (2 - t) - 1e-9)


def shared_bigrams(n: int, t: float) -> int:
    """Bigrams that a string of n characters shares with any partner at least; 0 or less: the bound says nothing."""
    return math.ceil((n + least_partner(n, t)) * (1.5 * t - 1) - 1 - 1e-9)


def bigram_length(t: float) -> int | None:
    """Length from which on strings meet by bigrams; None: never."""
    if 1.5 * t - 1 <= 0:
        return None
    n = 2
    while shared_bigrams(n, t) < 1:
        n += 1
    return n


def _tokens(strings: DataFrame, size: int) -> DataFrame:
    """id, n, size (tokens of the string), token: runs of `size` characters, the k-th of equals told from the first."""
    at = F.sequence(F.lit(1), F.col("n") - (size - 1))
    runs = strings.filter(F.col("n") >= size).select("id", "n", F.explode(F.transform(at, lambda i: F.substring("s", i, F.lit(size)))).alias("run"))
    counted = runs.groupBy("id", "n", "run").agg(F.count("*").alias("k"))
    return counted.select("id", "n", (F.col("n") - (size - 1)).alias("size"), F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("k"), "run").select("id", "n", "size", F.concat(F.col("k").cast("string"), F.lit(":"), "run").alias("token"))


def _prefixes(strings: DataFrame, size: int, shared: Column) -> DataFrame:
    """id, token: the rarest tokens by which each string must meet its partners, of which it shares `shared` at least."""
    tokens = cut_lineage(_tokens(strings, size))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(rarity, "token").groupBy("id", "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("all"))
    return ranked.select("id", F.explode(F.slice(F.col("all"), F.lit(1), (F.col("size") - shared + 1).cast("int"))).alias("x")).select("id", F.concat(F.lit(f"{size}/"), "x.token").alias("token"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, r: every distinct string a of left (column a) with every b of right (column b) where ratio(a, b) = r >= least."""
    known = left.select(F.col("a").alias("s"), F.lit(1).alias("side")).unionByName(right.select(F.col("b").alias("s"), F.lit(2).alias("side"))).filter("s IS NOT NULL")
    known = known.groupBy("s").agg(F.max(F.col("side") == 1).alias("in_a"), F.max(F.col("side") == 2).alias("in_b"))
    strings = cut_lineage(known.select(F.monotonically_increasing_id().alias("id"), "s", F.char_length("s").alias("n"), "in_a", "in_b", *(c.alias(m) for m, c in count_bits(F.col("s")).items())))
    share, partner = least / (2 - least), F.ceil(F.col("n") * (least / (2 - least)) - 1e-9)
    met = None
    long = bigram_length(least)
    if long is not None:
        by_bigrams = F.ceil((F.col("n") + partner) * (1.5 * least - 1) - 1 - 1e-9)
        met = _prefixes(strings.filter(F.col("n") >= long), 2, by_bigrams)
    # What is too short for bigrams, with all that it can be similar to.
    short = strings if long is None else strings.filter(F.col("n") <= math.floor((long - 1) / share + 1e-9))
    by_characters = F.greatest(F.lit(1), F.ceil((F.col("n") + partner) * least / 2 - 1e-9))
    characters = _prefixes(short, 1, by_characters)
    met = cut_lineage(characters if met is None else met.unionByName(characters))
    # Lengths that may be similar lie in one band or in neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / share)) if share < 1 else F.col("n").cast("long")
    held = strings.select("id", "n", *MASKS, "in_a", "in_b", band.alias("band"))
    sided = lambda d, p: d.select(F.col("id").alias(f"{p}id"), F.col("token").alias(f"{p}token"), F.col("band").alias(f"{p}band"), *(F.col(c).alias(p + c) for c in ("n", *MASKS)))
    rows = met.join(held, "id")
    a = sided(rows.filter("in_a"), "a_")
    b = sided(rows.filter("in_b"), "b_").withColumn("b_band", F.explode(F.array(F.col("b_band") - 1, F.col("b_band"), F.col("b_band") + 1)))
    enough = (2.0 * F.least("a_n", "b_n") >= least * (F.col("a_n") + F.col("b_n")) - 1e-9) & (2.0 * most_shared("a_", "b_") >= least * (F.col("a_n") + F.col("b_n")) - 1e-9)
    pairs = a.join(b, (F.col("a_token") == F.col("b_token")) & (F.col("a_band") == F.col("b_band")) & enough).select("a_id", "b_id").distinct()
    texts = strings.select("id", "s")
    found = pairs.join(texts.select(F.col("id").alias("a_id"), F.col("s").alias("a")), "a_id").join(texts.select(F.col("id").alias("b_id"), F.col("s").alias("b")), "b_id").select("a", "b").filter("a != b")
    near = found.withColumn("r", ratio("a", "b")).filter(F.col("r") >= least)
    # Equal strings, empty ones too, need no comparison.
    return near.unionByName(strings.filter("in_a AND in_b").select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit(1.0).alias("r")))


def similar_titles(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, sim: every title of left (column a) with every one of right (column b) whose best pair of forms reaches `least`."""
    opened = lambda d, c: d.select(c).distinct().select(c, F.explode(F.array_distinct(F.filter(F.array(*title_forms(F.col(c))), lambda f: f.isNotNull()))).alias(f"f{c}"))
    fa, fb = cut_lineage(opened(left, "a")), cut_lineage(opened(right, "b"))
    near = similar_pairs(fa.select(F.col("fa").alias("a")), fb.select(F.col("fb").alias("b")), least).select(F.col("a").alias("fa"), F.col("b").alias("fb"), "r")
    return near.join(fa, "fa").join(fb, "fb").groupBy("a", "b").agg(F.max("r").alias("sim"))
