"""Range scans, address blocks and refresh waves against plain loops."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import addresses, refresh, scan, store, telemetry


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Ranges stay apart however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot_rows(seed, n=900):
    """Two thirds of the rows are of one key; times and values recur."""
    rng = random.Random(seed)
    return [(None if k == 9 else k, rng.randrange(300), i, rng.choice([None, rng.randrange(-5, 6)])) for i in range(n) for k in [rng.choice([1, 1, 1, 1, 2, 3, 9])]]


@pytest.mark.parametrize("seed", [1, 2])
def test_running_values(spark, seed):
    rows = hot_rows(seed)
    ranges = scan.Ranges(spark.createDataFrame(rows, "k long, at long, id long, v long").repartition(5), "k", ["at", "id"])
    assert ranges.rows.filter("k = 1").select("_range").distinct().count() > 2
    total, last, place, want = {}, {}, {}, set()
    for k, at, i, v in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2])):
        total[k], place[k] = total.get(k, 0) + (v or 0), place.get(k, 0) + 1
        last[k] = v if v is not None else last.get(k)
        want.add((i, total[k], last[k], place[k]))
    found = {}
    for out in (ranges.running_sum(F.col("v"), "x"), ranges.last_known(F.col("v"), "x"), ranges.numbered("x")):
        for r in out.select("id", "x").collect():
            found.setdefault(r.id, []).append(r.x)
    assert {(i, *x) for i, x in found.items()} == want


def test_no_task_holds_a_hot_key(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"))
    rows = scan.Ranges(df, "k", ["at"]).rows
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert max(sizes) < 3 * 40_000 / 8 and rows.filter("k = 7").select("_range").distinct().count() >= 3


def test_most_open(spark):
    rng = random.Random(3)
    jobs = [(rng.choice([1, 1, 1, 2]), s := rng.randrange(200), s + rng.randrange(0, 30)) for _ in range(600)]
    got = {r.k: r.most_open for r in scan.most_open(spark.createDataFrame(jobs, "k long, s long, e long"), "k", "s", "e").collect()}
    want = {}
    for k in {j[0] for j in jobs}:
        marks = sorted([(s, 1) for x, s, _ in jobs if x == k] + [(e, -1) for x, _, e in jobs if x == k])
        n = most = 0
        for i, (at, d) in enumerate(marks):
            n += d
            # Equal marks count together.
            if i + 1 == len(marks) or marks[i + 1] != (at, d):
                most = max(most, n)
        want[k] = most
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_and_values_before(spark, seed):
    rows = hot_rows(seed)
    ranges = scan.Ranges(spark.createDataFrame(rows, "k long, at long, id long, v long").repartition(5), "k", ["at", "id"])
    runs = {r.id: (r.run, r.place) for r in ranges.runs(F.col("v") > 2, "run", "place").collect()}
    past = {r.id: (r.last, r.most) for r in ranges.last_values({"last": F.col("v"), "most": F.when(F.col("v") == 5, F.col("id"))}, own=False).collect()}
    n, start, last, most = {}, {}, {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2])):
        n[k] = n.get(k, 0) + 1
        begin = start.setdefault(k, 1)
        assert runs[i] == (begin, n[k] - begin + 1) and past[i] == (last.get(k), most.get(k))
        if v is not None:
            last[k] = v
            start[k] = n[k] + 1 if v > 2 else begin
            most[k] = i if v == 5 else most.get(k)


@pytest.mark.parametrize("seed", [1, 2])
def test_uptime(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["store", "store", "cache", "other", None]), rng.randrange(900), i, rng.choice([True, True, False, None]), rng.choice([None, 1.0, 5.0, 5.1])) for i in range(500)]
    rows.append((4, "cache", 7, 999, True, 1.0))
    probes = spark.createDataFrame(rows, "k long, part string, s long, id long, up boolean, took double").withColumn("at", F.timestamp_seconds("s")).repartition(4)
    got = {r.k: tuple(r)[1:] for r in telemetry.uptime(telemetry.health_changes(probes, "k", ["at", "id"]), "k", "at", ["at", "id"]).collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3]))
        state, was, outages, total, since = {}, True, 0, 0, None
        for _, part, s, _, up, took in mine:
            if since is not None:
                total += s - since
            state[part] = bool(up) and (took or 0) <= 5
            now = state.get("store", False) and state.get("cache", True)
            outages += was and not now
            was, since = now, s if now else None
        assert got[k] == (len(mine), was, outages, total * 1_000_000, (mine[-1][2] - mine[0][2]) * 1_000_000)


def test_cache_split_of_a_hot_key(spark):
    rng = random.Random(4)
    at = lambda s: F.timestamp_seconds(s)
    probes = [(rng.choice([1, 1, 1, 2]), rng.randrange(20_000)) for _ in range(500)] + [(1, 77), (1, 77)]
    writes = [(rng.choice([1, 1, 1, 2]), rng.randrange(20_000)) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "key long, s long").select("key", at("s").alias("ts"))
    got = sorted((r.key, int(r.ts.timestamp()), r.hit) for r in store.cache_split(frame(probes), frame(writes), 600).collect())
    assert got == sorted((k, s, any(w == k and s - 600 <= t <= s for w, t in writes)) for k, s in probes)


ODD = ["10.0.0.999", "2560.0.1", "1.2.3", "1.2.3.4.5", "", " 10.1.2.3 ", None, "unknown", "::1", "::", ":::", "1::2::3", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "::ffff:10.1.2.3", "::ffff:10.1.2.300", "12345::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "fe80::1.2.3.4", "g::1", "10.1.2.3/8", "010.1.2.3", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]


def plain(text):
    try:
        ip = ipaddress.ip_address(".".join(p.lstrip("0") or "0" for p in text.split(".")) if text.count(".") == 3 and ":" not in text else text)
    except (ValueError, AttributeError):
        return None
    return getattr(ip, "ipv4_mapped", None) or ip


def test_addresses(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "ip string").withColumn("a", addresses.address(F.col("ip")))
    for r in df.collect():
        want = plain(r.ip.strip() if r.ip else r.ip)
        got = None if r.a is None else (r.a.family, (r.a.hi % (1 << 64) << 64) + r.a.lo % (1 << 64))
        assert got == (None if want is None else (want.version, int(want))), r.ip


def test_most_specific_block(spark):
    rng = random.Random(5)
    v4 = lambda: ".".join(str(rng.choice([10, 11, rng.randrange(256)])) for _ in range(4))
    v6 = lambda: ":".join(f"{rng.choice([0x2001, 0xDB8, rng.randrange(1 << 16)]):x}" for _ in range(8))
    blocks = [f"{v4()}/{rng.randrange(33)}" for _ in range(150)] + [f"{v6()}/{rng.randrange(129)}" for _ in range(150)] + ["10.0.0.0/8", "10.10.0.0/16", "::/0", "10.0.0.1", "2001::/64", "2001::/65", "1.2.3.4/33", "x/8", "10.0.0.0/", None]
    ips = [v4() for _ in range(200)] + [v6() for _ in range(100)] + ["10.0.0.1", "10.10.11.10", "2001::8000:0:0:1", "2001::7000:0:0:1", *ODD]
    nets = {}
    for b in blocks:
        try:
            nets.setdefault(ipaddress.ip_network(b, strict=False), []).append(b)
        except ValueError:
            continue
    got = addresses.with_block(spark.createDataFrame([(x,) for x in ips], "ip string"), "ip", spark.createDataFrame([(b,) for b in blocks], "block string"))
    for r in got.collect():
        ip = plain(r.ip.strip() if r.ip else r.ip)
        inside = [n for n in nets if ip is not None and n.version == ip.version and ip in n]
        want = min(nets[max(inside, key=lambda n: n.prefixlen)]) if inside else None
        assert r.block == want, r.ip
    one = spark.createDataFrame([(x,) for x in ODD], "ip string").select("ip", addresses.allowed(F.col("ip"), "10.0.0.0/8").alias("ok")).collect()
    assert {r.ip for r in one if r.ok} == {" 10.1.2.3 ", "::ffff:10.1.2.3", "010.1.2.3"} - ({"010.1.2.3"} if plain("010.1.2.3") is None else set()) and all(r.ok is not None for r in one)


def test_refresh_waves(spark):
    now, old, new = "2024-06-10", "2024-06-01", "2024-06-09"
    kind = "id long, region string, updated_at string, failed boolean"
    frame = lambda rows: spark.createDataFrame(rows, kind).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    authors = frame([(1, "us", old, False), (2, "us", new, False), (3, "de", old, True), (4, None, None, None)])
    books = frame([(10, "us", new, False), (11, "us", old, False), (12, "us", new, False), (13, "de", new, False), (14, "us", new, True)])
    chapters = frame([(100, "us", new, False), (101, "us", new, False), (102, "us", new, False)])
    links = {"book": spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (4, 14), (4, 10)], "parent long, id long"), "chapter": spark.createDataFrame([(10, 100), (12, 101), (14, 102)], "parent long, id long")}
    work = refresh.waves({"author": authors, "book": books, "chapter": chapters}, links, F.lit(now).cast("timestamp"))
    got = {(r.kind, r.id): (r.wave, r.cause, r.failed) for r in work.collect()}
    assert got == {
        ("author", 1): (0, "stale", False), ("author", 3): (0, "stale", True), ("author", 4): (0, "stale", False), ("book", 10): (1, "parent", False), ("book", 11): (1, "stale", False), ("book", 14): (1, "parent", True), ("chapter", 100): (2, "parent", False),
    }
    plan = refresh.scheduled(work, 2)
    assert {(r.kind, r.id): (r["round"], r.slot) for r in plan.collect()} == {("author", 1): (0, 0), ("author", 3): (0, 0), ("author", 4): (0, 0), ("book", 11): (0, 0), ("book", 10): (0, 1), ("book", 14): (1, 0), ("chapter", 100): (0, 0)}
    assert {(r.wave, r.region): (r.total, r.success, r.failures, r.rounds) for r in refresh.summary(plan).collect()}[1, "us"] == (3, 2, 1, 2)


def test_a_wave_meets_its_records_once(spark, monkeypatch):
    """Of a wave only what isn't stale meets what hangs on the wave before, and nothing else is joined; a row given twice is two rows, not four."""
    plans, real = [], refresh.cut_lineage
    monkeypatch.setattr(refresh, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    rows = spark.createDataFrame([(1, "us", None, False), (1, "us", None, False), (None, "us", None, False)], "id long, region string, updated_at timestamp, failed boolean")
    links = spark.createDataFrame([(1, 1)], "parent long, id long")
    work = refresh.waves({"author": rows, "book": rows}, {"book": links}, F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r.wave, r.id, r.cause) for r in work.collect()) == [(0, 1, "stale")] * 2 + [(1, 1, "stale")] * 2
    assert [p.count("Join ") for p in plans] == [0, 2]
