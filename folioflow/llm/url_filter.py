"""URL filters: rules by host and path, and a verdict by link-graph propagation for hosts that no rule covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import durable, join_salted, sized

DAMPING = 0.85
#: Propagation goes on until no host's rank changes by more than this part of what one seed starts with.
TOLERANCE = 1e-4
#: Trust and distrust that differ by less than rounding are equal.
EQUAL = 1e-9
#: A host is distrusted if this damped share of its own out-links leads to blocked seeds, and it has more distrust than trust.
MIN_SHARE = 0.1
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of what follows the first ://; empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path); null without one. Ties: the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last wrapped is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages (host, html) of src that link to another host dst, summed in each task before the shuffle."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    links = pages.where("host != '' and html is not null").select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
    return links.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, steps: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): what seeds (kind, host, base) have and, damped, pass on along steps (kind, host, dst, w).

    A round moves only what the one before it added. The last one adds at most tolerance of its kind's greatest base to
    any host; each round's additions shrink by damping at least, so there are log(tolerance) / log(damping) at most
    (57 as set), however large the graph is, and fewer where chains end.
    """
    steps, added = durable(steps), durable(seeds.select("kind", "host", F.col("base").alias("rank")))
    if steps.isEmpty():
        return added
    most = lambda: {r.kind: r.most for r in added.groupBy("kind").agg(F.max("rank").alias("most")).collect()}  # noqa: E731  # three kinds at most
    ranks, first, now = added, most(), {"": 1.0}
    while any(v > tolerance * first.get(kind, 0.0) for kind, v in now.items()):
        added = durable(added.join(steps, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("w") * damping).alias("rank")))
        ranks, now = ranks.unionByName(added), most()
    return ranks.groupBy("kind", "host").agg(F.sum("rank").alias("rank"))


def distrusted_hosts(judged: DataFrame, edges: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Hosts with more distrust than trust of whose links a min_share leads to blocked hosts, from pages (host, verdict) judged by rules and host edges (src, dst, n).

    Seeds are hosts most of whose pages one verdict of the rules covers. Trust flows along links from allowed seeds,
    distrust against them from blocked seeds: who links to a blocked host shares its rank. Seeds of one side do not
    pass on the other side's rank. A host's share is 1 for a blocked seed, 0 for an allowed one, and else the damped
    mean over its own links, so it does not depend on how many others link to the same blocked host.
    """
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    hosts = judged.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), count("allow").alias("allow"), count("block").alias("block"))
    seeds = durable(hosts.where("2 * greatest(allow, block) > n").select(F.when(F.col("block") > F.col("allow"), "distrust").otherwise("trust").alias("kind"), "host"))
    sums = seeds.groupBy("kind").agg(F.count("*").alias("seeds"))
    base = seeds.join(F.broadcast(sums), "kind").select("kind", "host", ((1 - DAMPING) / F.col("seeds")).alias("base"))  # two rows
    base = base.unionByName(seeds.where("kind = 'distrust'").select(F.lit("share").alias("kind"), "host", F.lit(1.0).alias("base")))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    others = seeds.select(F.when(F.col("kind") == "trust", "distrust").otherwise("trust").alias("kind"), F.col("host").alias("src"))
    free = both.join(others, ["kind", "src"], "left_anti")
    steps = free.join(free.groupBy("kind", "src").agg(F.sum("n").alias("all")), ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("w"))
    links = edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").join(seeds.select(F.col("host").alias("src")), "src", "left_anti")
    rank = propagate(base, steps.unionByName(links.select(F.lit("share").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("w"))))
    sides = rank.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust", "share")))
    return sides.where(f"distrust > trust * {1 + EQUAL} and share >= {min_share}").select("host")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row.

    A fitting rule decides (the list is a parameter of a few hundred entries at most); otherwise pages of distrusted
    hosts are blocked and all others, those without a host among them, allowed. Null urls have an empty host and
    path, null html has no links; equal rows give equal rows; other columns are not read.
    """
    host, path = host_path(F.col(url_col).cast("string"))
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = slim.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    bad, few = sized(distrusted_hosts(judged, durable(host_edges(slim))).select("host", F.lit(True).alias("bad")))
    out = judged.join(F.broadcast(bad), "host", "left") if few else join_salted(judged, bad, "host", ["page_id", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
