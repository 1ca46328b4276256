"""The text index against brute force, on texts with words in all of them, in many and in one."""

import random
import re
from collections import Counter

import pytest

from folioforge.operators.text_index import TextIndex


def brute(records, queries, weighted, most):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = []
    for q in {x for x in queries if x is not None}:
        scored = []
        for key, text in records:
            own, n = Counter(cut(text)), len(cut(text))
            shared = [own[t] for t in set(cut(q)) if own[t]]
            if shared:
                scored.append((-sum(int(1e6 * (0.5 + 0.5 * tf / n) * (2 - 2.0 ** (1 - tf))) if weighted else 1 for tf in shared), key))
        out += [(q, key, -s, pos) for pos, (s, key) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def titles(seed, n):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(["the", *rng.choices(pool, weights=[30 - k for k in range(30)], k=rng.randrange(0, 5)), *([f"x{rng.randrange(n)}"] * rng.randrange(3))])) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "!?"), (n + 3, rows[0][1].upper()), (n + 4, "The-the the W1")]


@pytest.mark.parametrize("weighted,common,most", [(False, 128, 25), (True, 20, 25), (False, 5, 4), (True, 0, 3), (True, 10**6, 7)])
def test_search_equals_brute_force(spark, weighted, common, most):
    records = titles(7, 160)
    queries = [t for _, t in titles(8, 40)] + ["the", "w0 w1 the", "unknown", None]
    index = TextIndex(spark.createDataFrame(records, "id long, title string"), "id", "title", weighted, common)
    got = index.search(spark.createDataFrame([(q,) for q in queries], "query string"), most)
    assert sorted(map(tuple, got.collect())) == brute(records, queries, weighted, most)


def test_a_word_in_every_title_reads_postings_in_proportion(spark):
    """3,000 titles that all share two words: each as a query meets itself and the best 25 by them, not the 3,000."""
    records = [(i, f"the tale of x{i}") for i in range(3000)]
    df = spark.createDataFrame(records, "id long, title string")
    index = TextIndex(df, "id", "title", common=128)
    met = index.candidates(df.selectExpr("title AS query"))
    assert 3000 * 25 <= met.count() <= 3000 * 26
    got = {(r.query, r.pos): r.key for r in index.search(df.selectExpr("title AS query")).filter("query IN ('the tale of x7', 'the tale of x2999')").collect()}
    assert [got["the tale of x7", p] for p in (1, 2, 3)] == [7, 0, 1] and [got["the tale of x2999", p] for p in (1, 2, 25)] == [2999, 0, 23]


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, title string")
    assert TextIndex(none, "id", "title").search(spark.createDataFrame([("a",)], "query string")).count() == 0


def test_what_no_query_asks_for_makes_no_classes(spark):
    """Texts that share one asked word are one class, whatever common words they have besides."""
    records = [(i, f"tale m{i % 20} n{i // 20 % 6}") for i in range(600)]
    index = TextIndex(spark.createDataFrame(records, "id long, title string"), "id", "title", weighted=True, common=4)
    queries = spark.createDataFrame([("tale",), ("a tale",)], "query string")
    profiles = index._profiles(index._asked(queries))
    assert profiles.select("profile").distinct().count() == 1
    got = sorted(map(tuple, index.search(queries, 3).collect()))
    assert got == brute(records, ["tale", "a tale"], True, 3)


def test_classes_above_a_floor_are_met_once(spark):
    """Texts that the rarest word finds are beaten by texts with the others twice; each of these is given once."""
    records = [(i, f"old blue c{i % 40}") for i in range(60)] + [(60 + i, f"old blue old blue d{i % 15}") for i in range(60)] + [(120 + i, f"old e{i}") for i in range(30)] + [(200 + i, f"new old blue f{i}") for i in range(12)]
    index = TextIndex(spark.createDataFrame(records, "id long, title string"), "id", "title", weighted=True, common=3)
    queries = ["new blue old", "blue old", "c1 blue"]
    got = sorted(map(tuple, index.search(spark.createDataFrame([(q,) for q in queries], "query string"), 9).collect()))
    assert got == brute(records, queries, True, 9)
