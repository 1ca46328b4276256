"""URL filters: explicit rules first, link-graph propagation for the rest.

Rules name a host with its subdomains and a path prefix; the longest rule that
fits decides.  Hosts that no rule settles are judged by two personalised
PageRanks over host edges: trust flows along links from trusted seeds, distrust
flows against links from blocked seeds, so a host that links to blocked hosts
is distrusted.  A host is blocked where distrust exceeds trust by MARGIN times
an even share.  A seed is a host more than half of whose pages the rules block
(or allow).  Edges are links from a page's html to other hosts, counted per
pair of hosts before they are shuffled.  A host that neither links to another
nor is linked to falls back on the domain tree: one edge each way between it
and the next host above it that has pages.

Ranks go on until no host's changes by more than TOLERANCE of an even share, or
of itself where it is larger, over CUT_EVERY rounds; each change is at most
DAMPING of the one before, so they end.  What hosts without edges hold goes
back to the seeds, which is the same as bringing the ranks' sum to one at last.

All of it is DataFrame functions.  Rank tables are written to the shared folder
every few rounds, which cuts lineage.

Defined results: null url, or one without `://`, has empty host and path, no
rule, and no part in the graph; its verdict is allow, like that of any host
without trust or distrust.  Null html has no links.  Repeated rows are judged
alike; a very long url or page is read whole; empty tables, of pages or of
rules, give no rows and no rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import remove, shared_dir, table, written

#: (verdict, rule): host, a slash, path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, CUT_EVERY, TOLERANCE, MARGIN, SEED_SHARE = 0.85, 4, 0.01, 1.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>\\]+)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]"""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules of it and of what it is a subdomain of, longest first."""
    # The name apart from the prefix splits at the first slash.
    cut = F.instr("rule", "/")
    known = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("suffix"), F.substr("rule", cut).alias("prefix"))
    fits = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("suffix")).join(known, "suffix")
    return fits.groupBy("host").agg(F.sort_array(F.collect_set(F.struct((-F.length("rule")).alias("order"), "rule", "prefix", F.col("verdict")))).alias("rules"))


def _ranks(edges: DataFrame, seeds: DataFrame, hosts: int, work: str) -> DataFrame:
    """kind, host, rank: personalised PageRank of each kind over edges (kind, src, dst, share) from seeds (kind, host, mass); each kind's ranks add up to one."""
    spark = edges.sparkSession
    rank = before = seeds.select("kind", "host", F.col("mass").alias("rank"))
    rest = seeds.select("kind", "host", ((1 - DAMPING) * F.col("mass")).alias("rank"))
    old, r = None, 0
    while True:
        for _ in range(CUT_EVERY):
            moved = edges.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
            rank = moved.unionByName(rest).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        r += CUT_EVERY
        rank = written(rank, f"{work}/rank-{r}")
        both = rank.join(before.withColumnRenamed("rank", "before"), ["kind", "host"], "left")
        change = F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0))) * hosts
        unsettled = both.filter(change > TOLERANCE * F.greatest(F.lit(1.0), F.col("rank") * hosts)).limit(1).count()
        if old:
            remove(spark, old)
        if not unsettled:
            break
        before, old = rank, f"{work}/rank-{r}"
    total = rank.groupBy("kind").agg(F.sum("rank").alias("total"))
    return rank.join(F.broadcast(total), "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("rank"))


def host_scores(judged: DataFrame, links: DataFrame, work: str) -> DataFrame:
    """host, trust, distrust (multiples of an even share) from host, ruled (verdict or null), pages and host links src, dst, n."""
    per_host = judged.groupBy("host").agg(F.sum("pages").alias("pages"), *(F.sum(F.when(F.col("ruled") == v, F.col("pages")).otherwise(0)).alias(v) for v in ("allow", "block")))
    per_host = written(per_host, f"{work}/hosts")
    above = per_host.select("host", F.explode(_suffixes(F.col("host"))).alias("up")).filter("up != host")
    above = above.join(per_host.select(F.col("host").alias("up")), "up").groupBy("host").agg(F.max_by("up", F.length("up")).alias("up"))
    linked = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host"))).distinct()
    tree = above.join(linked, "host", "left_anti").select(F.col("host").alias("src"), F.col("up").alias("dst"), F.lit(1).cast("long").alias("n"))
    both = links.unionByName(tree).unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    along = both.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    edges = along.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(along.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), f"{work}/edges")
    seeds = per_host.select(F.lit("trust").alias("kind"), "host").filter(F.col("allow") > SEED_SHARE * F.col("pages")).unionByName(per_host.select(F.lit("distrust").alias("kind"), "host").filter(F.col("block") > SEED_SHARE * F.col("pages")))
    count = seeds.groupBy("kind").agg(F.count("*").alias("of"))
    seeds = written(seeds.join(count, "kind").select("kind", "host", (1 / F.col("of")).alias("mass")), f"{work}/seeds")
    hosts = per_host.count()
    ranks = _ranks(edges, seeds, hosts, work).groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    return ranks.select("host", (F.col("trust") * hosts).alias("trust"), (F.col("distrust") * hosts).alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame, work: str) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page (page_id, url, html)."""
    host, path = parts(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(F.regexp_replace(x, r"^.*@|:[0-9]*$", ""), UPPER, LOWER))).alias("to"))
    own = written(own, f"{work}/pages")
    hosts = own.filter("host != ''").select("host").distinct()
    ruled = written(host_rules(hosts, rules), f"{work}/rules")
    fit = F.element_at(F.filter("rules", lambda r: F.col("path").startswith(r["prefix"])), 1)
    fit = F.when(F.exists("rules", lambda r: F.col("path").startswith(r["prefix"])), fit)
    found = own.drop("to").join(ruled, "host", "left").withColumn("fit", fit).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    links = own.select(F.col("host").alias("src"), F.explode("to").alias("dst")).filter("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    tally = found.filter("host != ''").groupBy("host", "ruled").agg(F.count("*").alias("pages"))
    scores = written(host_scores(tally, links, work), f"{work}/scores")
    verdict = F.coalesce("ruled", F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) + MARGIN, "block").otherwise("allow"))
    return found.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    values = ", ".join(f"('{v}', '{r}')" for v, r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, rule)")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark), shared_dir(spark))
