"""The block-matching kernel against the standard library, and the similarity join against all pairs."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.functions import blocks
from folioforge.functions.similarity import ratio
from folioforge.operators import similarity_join as J


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", max_size=12), st.text("abé😀 ", max_size=12)), max_size=12))
def test_kernel_equals_the_standard_library(pairs):
    first, second = [x for x, _ in pairs], [y for _, y in pairs]
    assert blocks.ratios(first, second).tolist() == [plain(x, y) for x, y in pairs]


def test_kernel_on_titles_long_strings_and_small_tables(monkeypatch):
    rng = random.Random(1)
    title = lambda: " ".join("".join(rng.choices("abcdeirstn", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 7)))
    pairs = [(title(), title()) for _ in range(300)] + [("a" * 120, "ba" * 60), ("x" * 500, "x" * 501), ("xy" * 200 + "q" + "ab" * 80, "ab" * 90 + "xy" * 210), ("", "a"), ("", "")]
    want = [plain(x, y) for x, y in pairs]
    for cells in (blocks.CELLS, 500):
        monkeypatch.setattr(blocks, "CELLS", cells)
        assert blocks.ratios([x for x, _ in pairs], [y for _, y in pairs]).tolist() == want


def test_kernel_takes_a_fraction_of_the_time():
    rng = random.Random(2)
    title = lambda: "".join(rng.choices("abcdefghirstn ", k=rng.randrange(25, 45)))
    pairs = [(title(), title()) for _ in range(20_000)]
    began = time.process_time()
    found = blocks.ratios([x for x, _ in pairs], [y for _, y in pairs])
    ours = (time.process_time() - began) / len(pairs)
    began = time.process_time()
    want = [plain(x, y) for x, y in pairs[:1000]]
    theirs = (time.process_time() - began) / 1000
    assert found[:1000].tolist() == want
    assert ours < theirs / 6, (ours, theirs)


def strings(seed, n):
    """Strings with few words in common: letters changed, left out and moved, short and empty ones, other alphabets."""
    rng = random.Random(seed)
    out = ["", "a", "b", "ab", "ba", "abc", "zzz", "ééé", "日本語", "日本"]
    while len(out) < n:
        base = "".join(rng.choices("abcdefghijklmnoprstuvwy ", k=rng.randrange(2, 30)))
        out.append(base)
        for _ in range(rng.randrange(4)):
            x = list(base)
            for _ in range(rng.randrange(1, 5)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randrange(2)] = rng.choices("abcdexyz", k=rng.randrange(2))
            out.append("".join(x))
    return out


@pytest.mark.parametrize("least", [0.55, 0.7, 0.8, 0.95, 1.0])
def test_join_loses_no_pair(spark, least):
    left, right = strings(3, 110), strings(4, 90) + strings(3, 40)
    got = J.similar_pairs(spark.createDataFrame([(x,) for x in [*left, None]], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), least)
    want = {(x, y): r for x in set(left) for y in set(right) if (r := plain(x, y)) >= least}
    assert {(r.a, r.b): r.r for r in got.collect()} == want
    assert least > 0.8 or sum(not set(x.split()) & set(y.split()) for x, y in want) > 20


def test_join_of_many_unlike_strings_compares_few(spark):
    """4,000 strings: what is let through to be compared grows with the strings, not with their square."""
    rng = random.Random(5)
    some = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=24)) for _ in range(4000)]
    seen = spark.sparkContext.accumulator(0)
    real = J.ratio

    def counting(a, b):
        from pyspark.sql import functions as F
        from pyspark.sql.types import DoubleType

        @F.pandas_udf(DoubleType())
        def counted(x, y):
            seen.add(len(x))
            return real.func(x, y)

        return counted(a, b)

    J.ratio = counting
    try:
        df = spark.createDataFrame([(x,) for x in some], "a string")
        assert J.similar_pairs(df, df.withColumnRenamed("a", "b"), 0.8).count() == 4000
    finally:
        J.ratio = real
    assert seen.value < 4000


def test_titles(spark):
    a = spark.createDataFrame([("Dune: a saga",), ("Emma (large print)",), ("!!!",), ("",), (None,)], "a string")
    b = spark.createDataFrame([("dune",), ("Emma.",), ("???",), ("Dunes",)], "b string")
    got = {(r.a, r.b): round(r.sim, 6) for r in J.similar_titles(a, b, 0.8).collect()}
    assert got == {("Dune: a saga", "dune"): 1.0, ("Emma (large print)", "Emma."): 1.0, ("!!!", "???"): 1.0, ("Dune: a saga", "Dunes"): round(8 / 9, 6)}


def test_nulls(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "x"), ("abc", None), ("abcd", "bcde")], "a string, b string")
    assert [r.r for r in df.select(ratio("a", "b").alias("r")).collect()] == [1.0, None, None, 0.75]
    assert np.allclose(blocks.ratios([], []), [])
