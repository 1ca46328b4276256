"""Range join of embeddings, importance resampling, ranked search: against brute force, and odd inputs."""

import random
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import counting, metric_join, ranked_search, resample

DOCS = "doc_id long, text string, row long, bucket string, weight string, score string, item_id string, n string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "x", "x", "x", "x", "x") for i, t in rows], DOCS)


def texts(seed, n, vocabulary=80, least=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice([" ", "-", ", "]).join(f"W{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(rng.randrange(least, 60)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "é W1 É"), (n + 3, "?! .."), (n + 4, "w1 " * 3000), (n + 5, rows[3][1])]


# Counts


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_counts_in_pieces_equal_counts_of_the_whole(monkeypatch, runs):
    monkeypatch.setattr(counting, "PIECE", 11)
    for _, text in texts(1, 30):
        w = b" ".join(x for part in counting.words(text) for x in part).decode().split(" ") if text and any(counting.words(text)) else []
        want = Counter(" ".join(w[i : i + n]).encode() for n in range(1, runs + 1) for i in range(len(w) - n + 1))
        assert counting.counted(text, runs) == (len(w), want)


# Embeddings


def cloud(seed, dim=16, n=300, dtype=np.float32):
    """Groups of near vectors, exact copies, scaled copies, pairs near the threshold, and lone ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n // 10):
        base = rng.normal(size=dim)
        for k in range(rng.integers(1, 12)):
            rows.append(base + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.3, 0.45]))
            if k == 3:
                rows.append(2 * base)
    return [(3 * i + 1, x.astype(dtype).tolist()) for i, x in enumerate(rows)]


ODD = [(0, None), (2, []), (5, [0.0] * 16), (8, [1.0] * 15 + [None]), (11, [float("nan")] * 16), (14, [float("inf")] * 16), (17, [1.0, 1.0]), (20, [2.0, 2.0]), (23, [1e-30] * 16), (26, [1e30] * 16)]


@pytest.mark.parametrize("seed,kind,block", [(1, "float", None), (2, "float", 16), (3, "double", 40)])
def test_range_join(spark, tmp_path, seed, kind, block):
    rows = [*cloud(seed, dtype=np.float32 if kind == "float" else np.float64), *ODD]
    df = spark.createDataFrame([(i, v, "x", 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, node string, label int, component string")
    got = metric_join.range_join(df, f"file://{tmp_path}/w", block=block)
    want = sorted(metric_join.brute(rows))
    assert sorted(map(tuple, got.collect())) == want
    assert sum(x[1] > 0 for x in want) > 50 and len({x[2] for x in want}) > 30


def test_range_join_odd_rows(spark, tmp_path):
    v, w = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, v), (1, v), (2, v), (None, v), (3, w), (4, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in metric_join.range_join(df, f"file://{tmp_path}/w").collect())
    assert got == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
    assert metric_join.range_join(df.limit(0), f"file://{tmp_path}/e").count() == 0
    lone = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in metric_join.range_join(lone, f"file://{tmp_path}/l").collect()] == [(1, 0, 1, True)]


def test_hot_group_of_near_copies_in_many_units(spark, tmp_path):
    """A group far larger than a unit: complete counts, one component, and rows in proportion to vectors times units, not pairs."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.1).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, metric_join.range_join(df, f"file://{tmp_path}/w", block=32).collect()))
    assert got == sorted(metric_join.brute(rows)) and max(x[1] for x in got) > 350
    assert spark.read.parquet(f"file://{tmp_path}/w/found").count() < 500 * 30


def test_cells_are_ruled_out_where_vectors_gather():
    rng = np.random.default_rng(6)
    centre = np.linalg.qr(rng.normal(size=(32, 32)))[0][:12]
    x = np.repeat(centre, 50, axis=0) + rng.normal(size=(600, 32)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = metric_join.centres(x, 12)
    near = np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))
    own = near.argmin(axis=1)
    radius = np.array([near[own == c, c].max(initial=0) for c in range(12)])
    r = float(np.sqrt(0.2))
    may, _ = metric_join.reached(x, p, radius, r)
    assert may.sum() <= 1.5 * len(x)
    # Nothing within r lies in a cell that was ruled out.
    i, j = np.nonzero(x @ x.T >= 0.9)
    assert may[i, own[j]].all()


# Resampling


@pytest.mark.parametrize("runs,buckets", [(1, 10_000), (2, 37)])
def test_resampling(spark, tmp_path, runs, buckets):
    rows = [*texts(2, 120), (None, "W1 " * 30)]
    target = [t for _, t in texts(3, 9, 20)]
    got = resample.resample(frame(spark, rows), frame(spark, [(0, t) for t in target]), f"file://{tmp_path}/w", runs, buckets)
    have = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(have, key=order) == sorted(resample.brute(rows, target, runs, buckets), key=order)
    assert 3 < sum(x[4] is not None for x in have) < 20


def test_resampling_odd_rows(spark, tmp_path, monkeypatch):
    body = " ".join(f"w{i}" for i in range(25))
    rows = [(1, body)] * 10 + [(2, body + " w1")] * 10
    monkeypatch.setattr(resample, "RUN_DOCS", 3)
    got = resample.resample(frame(spark, rows), frame(spark, []), f"file://{tmp_path}/w").collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len({r.score for r in got if r["rank"]}) == 1
    assert Counter((r.doc_id, r.weight) for r in got) == Counter((x[0], x[2]) for x in resample.brute(rows, []))
    assert resample.resample(frame(spark, []), frame(spark, rows), f"file://{tmp_path}/e").count() == 0


# Search


@pytest.mark.parametrize("block,entries", [(ranked_search.BLOCK_BYTES, ranked_search.ENTRIES), (600, 50)])
def test_search(spark, tmp_path, monkeypatch, block, entries):
    monkeypatch.setattr(ranked_search, "ENTRIES", entries)
    rows = [*texts(5, 150), (None, "W1 W2 W3"), (7, "W1 W2 W40"), (7, "W1 W2 W40")]
    items = [(i, t) for i, t in texts(6, 12)] + [(3, "W1 other"), (3, "W1 other")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    got = sorted(map(tuple, ranked_search.search(frame(spark, rows), df, f"file://{tmp_path}/w", block_bytes=block).collect()))
    assert got == sorted(ranked_search.brute(rows, items)) and len(got) > 100


def test_search_of_nothing(spark, tmp_path):
    items = spark.createDataFrame([(1, "W1"), (2, None)], "item_id long, text string")
    assert ranked_search.search(frame(spark, []), items, f"file://{tmp_path}/a").count() == 0
    assert ranked_search.search(frame(spark, [(1, "W1"), (2, None)]), items.limit(0), f"file://{tmp_path}/b").count() == 0
    assert [tuple(r) for r in ranked_search.search(frame(spark, [(4, "w1"), (2, None), (3, "w2")]), items, f"file://{tmp_path}/c").collect()][0][:3] == (1, 1, 4)


@pytest.mark.parametrize("top", [10, 1 << 16, 1 << 20, 1 << 40])
def test_radix_order(top):
    key = np.random.default_rng(1).integers(0, top, 2000)
    assert (ranked_search.radix_order(key, top) == np.argsort(key, kind="stable")).all()


def test_norms_beyond_64_bits():
    n = np.array([1, 10**9])
    assert ranked_search.norms(n, 10**10, 10**13).tolist() == [75 + 25 * int(x) * 10**10 // 10**13 for x in n]
