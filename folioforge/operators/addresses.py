"""IPv4 and IPv6 addresses and blocks: parsing by column functions, and the most specific block of each address.

An address is its family (4 or 6) and two longs of its bits.  Blocks of one
prefix length are looked up by equal keys, the address cut to that length; there
are at most 33 lengths of one family and 129 of the other, so an address has as
many keys at most, whatever number of blocks there is, and nested blocks cost
nothing.  What isn't an address is in no block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V4 = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
#: Up to eight groups of four hexadecimal digits, `::` once at most, and maybe dotted digits at the end.
V6 = r"^[0-9A-Fa-f:]+(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value named, so that its expression stands in the plan once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dotted(text: Column) -> Column:
    """The number of four dotted parts of at most 255, else null."""
    parts = F.transform(F.when(text.rlike(V4), F.split(text, r"\.")), lambda p: p.cast("long"))
    number = lambda ps: F.aggregate(ps, F.lit(0).cast("long"), lambda total, p: total * 256 + p)
    return _let(parts, lambda ps: F.when(F.forall(ps, lambda p: p <= 255), number(ps)))


def _groups(text: Column) -> Column:
    """The eight groups of an IPv6 address without dotted digits as longs, else null."""
    listed = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))

    def filled(halves: Column) -> Column:
        sides = F.struct(listed(F.get(halves, F.lit(0))).alias("l"), listed(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("r"), F.size(halves).alias("n"))
        gap = lambda s: 8 - F.size(s["l"]) - F.size(s["r"])
        zeros = lambda s: F.array_repeat(F.lit("0"), F.greatest(gap(s), F.lit(0)))
        return _let(sides, lambda s: F.when((s["n"] == 1) & (gap(s) == 0), s["l"]).when((s["n"] == 2) & (gap(s) >= 1), F.concat(s["l"], zeros(s), s["r"])))

    hexed = lambda g: F.conv(g, 16, 10).cast("long")
    return _let(_let(F.split(text, "::"), filled), lambda gs: F.when(F.forall(gs, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")), F.transform(gs, hexed)))


def _long(groups: Column, first: int) -> Column:
    value = F.get(groups, F.lit(first))
    for k in range(1, 4):
        value = F.shiftleft(value, 16).bitwiseOR(F.get(groups, F.lit(first + k)))
    return value


def _address(family: int, hi: Column, lo: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def address(text: Column) -> Column:
    """struct<family, hi, lo> of an address, else null; an IPv4 address in IPv6 clothes (::ffff:a.b.c.d) is one."""

    def six(t: Column) -> Column:
        # Dotted digits at the end are two groups.
        tail = F.regexp_extract(t, r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
        pair = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535))))
        plain = F.when(tail == "", t).otherwise(F.concat(F.left(t, F.length(t) - F.length(tail)), _let(_dotted(tail), pair)))
        return _let(F.when(t.rlike(V6) & t.contains(":"), plain), lambda p: _let(_groups(p), halves))

    def halves(groups: Column) -> Column:
        return F.when(groups.isNotNull(), _let(F.struct(_long(groups, 0).alias("hi"), _long(groups, 4).alias("lo")), clothed))

    def clothed(a: Column) -> Column:
        mapped = (a["hi"] == 0) & (F.shiftrightunsigned(a["lo"], 32) == 0xFFFF)
        return F.when(mapped, _address(4, F.lit(0), a["lo"].bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(_address(6, a["hi"], a["lo"]))

    four = lambda t: _let(_dotted(t), lambda n: F.when(n.isNotNull(), _address(4, F.lit(0), n)))
    return _let(F.trim(text), lambda t: F.coalesce(four(t), six(t)))


def _cut(a: Column, bits: Column) -> Column:
    """struct<hi, lo> of the first `bits` bits of an address."""
    # A shift by a whole long is none, so whole halves are left out by hand.
    v4 = F.struct(F.lit(0).cast("long").alias("hi"), F.call_function("shiftright", a["lo"], 32 - bits).alias("lo"))
    top = F.when(bits == 0, F.lit(0).cast("long")).when(bits >= 64, a["hi"]).otherwise(F.call_function("shiftrightunsigned", a["hi"], 64 - bits))
    low = F.when(bits <= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", a["lo"], 128 - bits))
    return F.when(a["family"] == 4, v4).otherwise(F.struct(top.alias("hi"), low.alias("lo")))


def parsed_blocks(blocks: DataFrame, block: str) -> DataFrame:
    """block, family, bits, hi, lo of the blocks that can be read; an address alone is a block of itself."""
    parts = F.split(F.trim(F.col(block)), "/")
    base, given = address(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    width = F.when(F.col("a.family") == 4, 32).otherwise(128)
    read = blocks.select(F.col(block).alias("block"), base.alias("a"), F.size(parts).alias("n"), given.alias("given")).filter("a IS NOT NULL AND n <= 2")
    bits = F.when(F.col("given").isNull(), width).when(F.col("given").rlike("^[0-9]{1,3}$"), F.col("given").cast("int"))
    read = read.withColumn("bits", bits).filter((F.col("bits") >= 0) & (F.col("bits") <= width))
    return read.select("block", "a.family", "bits", _cut(F.col("a"), F.col("bits")).alias("cut")).select("block", "family", "bits", "cut.hi", "cut.lo")


def with_block(df: DataFrame, ip: str, blocks: DataFrame, block: str = "block", out: str = "block") -> DataFrame:
    """df with the most specific of the blocks (column `block`) that its address lies in, the first by name of equals; null: in none, or no address."""
    known = parsed_blocks(blocks, block).groupBy("family", "bits", "hi", "lo").agg(F.min("block").alias("_block"))
    lengths = {4: [], 6: []}
    for r in known.select("family", "bits").distinct().collect():  # 162 rows at most
        lengths[r["family"]].append(r["bits"])
    listed = lambda f: F.array(*map(F.lit, sorted(lengths[f]))).cast("array<int>")
    asked = df.select(F.col(ip).alias("_ip")).distinct().withColumn("a", address(F.col("_ip"))).filter("a IS NOT NULL")
    keys = asked.select("_ip", "a", F.explode(F.when(F.col("a.family") == 4, listed(4)).otherwise(listed(6))).alias("bits"))
    keys = keys.select("_ip", "a.family", "bits", _cut(F.col("a"), F.col("bits")).alias("cut")).select("_ip", "family", "bits", "cut.hi", "cut.lo")
    found = keys.join(known, ["family", "bits", "hi", "lo"]).groupBy("_ip").agg(F.max_by("_block", "bits").alias(out))
    return df.join(found, F.col(ip) == F.col("_ip"), "left").drop("_ip")


def allowed(ip: Column, cidr: str) -> Column:
    """Whether an address lies in a block; false for what is no address."""
    base, bits = cidr.split("/")
    width = F.lit(int(bits))
    inside = lambda a, b: (a["family"] == b["family"]) & (_cut(a, width) == _cut(b, width))
    return F.coalesce(_let(address(ip), lambda a: _let(address(F.lit(base)), lambda b: inside(a, b))), F.lit(False))
