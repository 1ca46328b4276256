"""Substring dedup, n-gram join, decontamination: against brute force, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, ngram_join, substring_dedup, textops
from folioforge.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, node string, component string, sig string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x") for i, t in rows], DOCS)


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def passages(seed):
    """Documents that share passages at many places, with copies, repeats inside one, nulls, blanks and case."""
    rng = random.Random(seed)
    shared = [words(rng, rng.randrange(30, 120)) for _ in range(6)]
    rows = []
    for i in range(60):
        body = words(rng, rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            body += rng.choice(shared)[rng.randrange(10) :] + words(rng, rng.randrange(20))
        sep = rng.choice([" ", "\n", " \t"])
        rows.append((i, sep.join(body)))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, None), (103, ""), (104, " \n\t"), (105, " ".join(shared[0] * 4)), (106, " ".join(["a"] * 200)), (107, " ".join(["a"] * 90)), (108, "x" * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 12)])
def test_substring_dedup(spark, tmp_path, seed, window):
    rows = passages(seed)
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.kept(substring_dedup.dedup(frame(spark, rows), f"file://{tmp_path}/w", window), window).collect()}
    assert got == {x[0]: x for x in substring_dedup.brute(rows, window)}
    assert sum(x[2] > 0 for x in got.values()) > 10


def test_substring_dedup_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(70))
    rows = [(1, long), (1, long), (None, long), (2, long), (2, "other " + long)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.kept(substring_dedup.dedup(frame(spark, rows), f"file://{tmp_path}/w")).collect())
    assert got == [(0, 70, 0), (1, 70, 0), (1, 70, 0), (2, 70, 70), (2, 71, 70)]
    assert substring_dedup.kept(substring_dedup.dedup(frame(spark, []), f"file://{tmp_path}/e")).count() == 0


def twins():
    """Two words of 1,024 letters that polynomials modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_whose_plain_hashes_agree_are_told_apart(spark, tmp_path):
    one, other = twins()
    rest = [f"w{i}" for i in range(59)]
    rows = [(1, " ".join([*rest[:30], one, *rest[30:]])), (2, " ".join([*rest[:30], other, *rest[30:]])), (3, one), (4, other), (5, other)]
    removed = {r.doc_id: r.n_removed for r in substring_dedup.kept(substring_dedup.dedup(frame(spark, rows), f"file://{tmp_path}/w")).collect()}
    assert removed == dict.fromkeys(range(1, 6), 0)
    found, _ = ngram_join.join(frame(spark, rows), f"file://{tmp_path}/j")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == ngram_join.brute(rows)


def test_digests_of_runs_of_words():
    texts = ["a  b\tc", "c d", "", " e", "f "]
    data = "".join(texts).encode()
    words = textops.cut(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), textops.BLANK_WORDS, seeds=0)
    assert textops.joined(words).tobytes() == b"a b c c d e f "
    parts = textops.joined(words).tobytes().split(b" ")[:-1]
    assert [bytes(words.buf[s:e]) for s, e in zip(words.starts, words.ends, strict=True)] == parts
    runs = textops.digests(words, np.array([0, 2, 3, 0]), np.array([1, 3, 4, 3]))
    assert (runs[1] == runs[2]).all() and len({tuple(x) for x in runs.tolist()}) == 3
    for text in ("", "   ", "abc"):
        lone = textops.cut(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), textops.BLANK_WORDS, seeds=0)
        assert textops.joined(lone).tobytes() == (b"abc " if text == "abc" else b"")
        assert len(textops.strong(lone, 5).hashes[0]) == len(lone.starts)


def test_keyed_hashes_tell_words_apart():
    """Equal words have equal hashes wherever they stand; different ones, of any length and with zero bytes, differ."""
    rng = random.Random(3)
    every = [bytes(rng.choice([0, 1, 97, 98, 255]) for _ in range(rng.randrange(1, 20))) for _ in range(4000)] + [x.encode() for x in twins()] + [b"a" * n for n in range(1, 40)]
    rng.shuffle(every)
    data = b" ".join(every + every)
    found = textops.strong(textops.cut(np.frombuffer(data, np.uint8), np.array([0, len(data)]), textops.BLANK_WORDS, seeds=0), 77, 2)
    for lane in found.hashes:
        assert len(dict(zip(every + every, lane.tolist(), strict=True))) == len(set(every)) == len(set(lane.tolist()))
    other = textops.strong(textops.cut(np.frombuffer(data, np.uint8), np.array([0, len(data)]), textops.BLANK_WORDS, seeds=0), 78, 2)
    assert (found.hashes[0] != other.hashes[0]).all()


def test_index_grows_by_batches(spark, tmp_path):
    """Runs of one batch each, then compaction, hold the entries of one run of everything."""
    rows = [(i, t) for i, t in passages(3) if i is not None]
    logs = []
    for n, fanout in ((1, 9), (4, 9), (4, 1)):
        log = substring_dedup.FingerprintLog(spark, f"file://{tmp_path}/{n}-{fanout}", fanout)
        for b in range(n):
            log.append(substring_dedup.segments(frame(spark, rows).filter(F.pmod("doc_id", F.lit(n)) == b)))
            log.settle()
        logs.append((len(log.paths), sorted(map(tuple, log._summary(log.entries()).collect()), key=str)))
    assert [n for n, _ in logs] == [1, 4, 1] and logs[0][1] == logs[1][1] == logs[2][1] and len(logs[0][1]) > 20


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_substring_dedup_in_any_batches(spark, tmp_path, batches):
    """Passages met within a batch and across batches; ids at both ends of their range."""
    top = 2**63 - 1
    rows = [({0: -top, 59: top}.get(i, i), t) for i, t in passages(5)]
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.kept(substring_dedup.dedup(frame(spark, rows), f"file://{tmp_path}/w", 20, batches), 20).collect()}
    assert got == set(substring_dedup.brute(rows, 20))


def test_the_log_is_opened_again_for_the_next_day(spark, tmp_path):
    """Three days, each by a call of its own on the stored log, equal one run over everything; a day comes once."""
    rows = [(i, t) for i, t in passages(6) if i is not None]
    ids = sorted(i for i, _ in rows)
    cuts = [-1, ids[len(ids) // 3], ids[2 * len(ids) // 3], ids[-1]]
    got, seen = set(), []
    for day, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        fresh = [r for r in rows if low < r[0] <= high]
        out = substring_dedup.dedup_next(frame(spark, fresh), frame(spark, seen), f"file://{tmp_path}/log", f"file://{tmp_path}/work-{day}", 20, fanout=1)
        got |= {tuple(r) for r in substring_dedup.kept(out, 20).collect()}
        seen += fresh
    assert got == set(substring_dedup.brute(rows, 20)) and sum(x[2] > 0 for x in got) > 10
    log = substring_dedup.FingerprintLog(spark, f"file://{tmp_path}/log")
    assert log.upto == ids[-1] and len(log.paths) == 1 and all((tmp_path / "log" / p.rpartition("/")[2]).exists() for p in log.paths)
    with pytest.raises(ValueError):
        substring_dedup.dedup_next(frame(spark, rows[:5]), frame(spark, []), f"file://{tmp_path}/log", f"file://{tmp_path}/late", 20)


def test_a_lost_attempt_leaves_the_log_as_it_was(spark, tmp_path):
    rows = [(i, t) for i, t in passages(7) if i is not None and i < 60]
    first, second = [r for r in rows if r[0] < 30], [r for r in rows if r[0] >= 30]
    path = f"file://{tmp_path}/log"
    substring_dedup.dedup_next(frame(spark, first), frame(spark, []), path, f"file://{tmp_path}/a", 20).count()
    torn = substring_dedup.FingerprintLog(spark, path)
    torn.append(substring_dedup.segments(frame(spark, second), 20))  # written, but not committed
    out = substring_dedup.dedup_next(frame(spark, second), frame(spark, first), path, f"file://{tmp_path}/b", 20)
    assert {tuple(r) for r in substring_dedup.kept(out, 20).collect()} == {x for x in substring_dedup.brute(rows, 20) if x[0] >= 30}


def near_copies(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for size in (1, 3, 4, 7, 9, 15, 30, 60, 150, 400, 900):
        base = words(rng, size, 400)
        for k in range(6):
            body = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, size * k // 90))):
                body[rng.randrange(len(body))] = f"v{rng.randrange(9999)}"
            rows.append((i, " ".join(body).title() if k == 4 else " ".join(body)))
            i += 1
    return [*rows, (900, rows[40][1]), (901, None), (902, ""), (903, "  "), (904, "a a a a a a a a"), (905, "a a a a a")]


@pytest.mark.parametrize("seed,rule", [(1, ngram_join.Rule()), (2, ngram_join.Rule(5, 80)), (3, ngram_join.Rule(2, 60))])
def test_ngram_join(spark, tmp_path, seed, rule):
    rows = near_copies(seed)
    want = ngram_join.brute(rows, rule)
    for split in (ngram_join.SPLIT_OVER, 2):  # nearly every signature is divided
        found, _ = ngram_join.join(frame(spark, rows), f"file://{tmp_path}/{split}", rule, split)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_hot_group_and_common_passage(spark, tmp_path):
    """Many near copies of one text, and one passage inside many others, linked right."""
    rng = random.Random(5)
    base, passage = words(rng, 120, 500), words(rng, 60, 500)
    rows = []
    for i in range(90):
        body = list(base)
        for _ in range(rng.randrange(0, 6)):
            body[rng.randrange(120)] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(body)))
    rows += [(200 + i, " ".join(words(rng, 40, 5000) + passage)) for i in range(60)]
    found, _ = ngram_join.join(frame(spark, rows), f"file://{tmp_path}/w")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == ngram_join.brute(rows)


def test_ngram_join_odd_rows(spark, tmp_path):
    t = "one two three four five six seven"
    rows = [(5, t), (5, "other words that stand alone here"), (7, t), (None, t), (9, "other words that stand alone here"), (3, "")]
    found, _ = ngram_join.join(frame(spark, rows), f"file://{tmp_path}/w")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found.collect()) == [(0, 0), (3, 3), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert ngram_join.join(frame(spark, []), f"file://{tmp_path}/e")[0].count() == 0
    kept = ngram_join.keep_one(frame(spark, rows), f"file://{tmp_path}/k", ngram_join.Rule())
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 5, 5]


def test_components_of_a_long_chain(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50)], "u long, v long")
    got = {r.node: r.component for r in components(edges, f"file://{tmp_path}/c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50}


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 150])
def test_decontamination(spark, block):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(0, 40), 300))) for i in range(30)] + [(40, None), (41, ""), (42, "É2 b"), (43, "W1, w2; W3")]
    docs = []
    for i in range(40):
        body = words(rng, rng.randrange(0, 200), 300)
        if i % 2:
            cut = (items[rng.randrange(30)][1]).split()
            body[5:5] = cut
        docs.append((i, "-".join(body) if i % 3 else " ".join(body).upper()))
    docs += [(90, None), (91, ""), (92, "é2 B"), (93, "É2 b, w1 w2 w3 and more"), (94, "x" * 4000)]
    found = decontaminate.judged(decontaminate.contamination(frame(spark, docs), bench(spark, items), block_bytes=block))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()}
    want = decontaminate.brute(docs, items)
    assert {k: (v[0], v[1], len(v[2]), v[3]) for k, v in got.items()} == {k: (v[0], v[1], v[2], v[4]) for k, v in want.items()}
    kept = decontaminate.remove_documents(frame(spark, docs), bench(spark, items), block_bytes=block)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in want.items() if not v[4]) and kept.columns == frame(spark, docs).columns


def test_decontamination_of_nothing(spark):
    assert decontaminate.contamination(frame(spark, []), bench(spark, [(1, "a b")])).count() == 0
    assert decontaminate.judged(decontaminate.contamination(frame(spark, [(1, "a b"), (None, "a b"), (1, "a b")]), bench(spark, []))).filter("contaminated").count() == 0


def test_window_set_is_compact_and_tells_equal_hashes_apart():
    """Repeated windows are kept once; the arrays stay within a few times the text."""
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 200, 5000))) for i in range(200)] + [(900, "a " * 5000), (901, "a " * 40)]
    found = decontaminate.WindowSet(items)
    size = len(found.text) + sum(x.nbytes for parts in found.by_length.values() for x in parts)
    assert size < 8 * sum(len(t) for _, t in items)
    assert len(found.by_length[13][0]) == 200 * 188 + 2
    table, item, start, bytes_ = found.by_length[13]
    found.by_length[13] = np.zeros_like(table), item, start, bytes_  # as if all hashes were equal
    body = found.text[start[5] : start[5] + bytes_[5]]
    assert found._items(13, 0, len(table), body) == {str(items[item[5]][0])}
