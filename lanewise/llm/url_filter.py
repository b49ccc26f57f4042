"""URL filters: rules first, then trust and distrust propagated over the links between hosts.

Host edges come from the absolute links of each page, counted per pair of hosts. Trust starts at hosts in
proportion to their pages that a rule allows and follows links (personalised PageRank); distrust starts in
proportion to pages that a rule blocks and follows links backwards, so that who links to blocked hosts is
distrusted. Both are kept in one table of (mode, host, rank) and take ``iterations`` steps; hosts without
an edge in a mode keep their mass. A page that no rule fits is blocked where its host's distrust exceeds
``margin`` times its trust, and allowed elsewhere.

DataFrame functions only. Edges are summed before they are joined; ranks and edges stay in tables. Hosts with very
many pages or links meet them by broadcast, a bounded number of hosts. After t steps the ranks are within
2 * damping ** t (in sum, 0.08 for 20 steps) of those that more steps lead to. Distrust that equals margin times trust
doesn't block.
Null url, or one without ``://``: empty host and path, no rule, allowed. Null html: no links. Repeated rows
count once each as seeds and get one result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import cut, hot_keys, joined

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING, ITERATIONS, MARGIN = 0.85, 20, 1.0
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(https?:)?//([^/?#"'\s>]+)"""


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return _lower(raw), F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits stays
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, by_rule of every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return split.select("*", name.alias("rule"), verdict.alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target, links: counts of links between different hosts; pages: url, html."""
    host, _ = host_and_path(F.col("url"))
    links = pages.where("html is not null").select(host.alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(2)))).alias("target"))
    links = links.select("source", _lower(F.col("target")).alias("target")).where("source <> '' and source <> target")
    return links.groupBy("source", "target").agg(F.count("*").cast("double").alias("links"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """mode, host, rank after the given steps. seeds: mode (trust or distrust), host, mass; edges: source, target, links."""
    totals = seeds.groupBy("mode").agg(F.sum("mass").alias("total"))
    start = cut(seeds.join(F.broadcast(totals), "mode").select("mode", "host", (F.col("mass") / F.col("total")).alias("mass")), "seeds")  # two totals
    both = edges.select(F.lit("trust").alias("mode"), "source", "target", "links").unionByName(edges.select(F.lit("distrust").alias("mode"), F.col("target").alias("source"), F.col("source").alias("target"), "links"))
    out = both.groupBy("mode", "source").agg(F.sum("links").alias("out"))
    steps = cut(both.join(out, ["mode", "source"]).select("mode", F.col("source").alias("host"), "target", (F.col("links") / F.col("out")).alias("share")), "steps")
    ranks = start.withColumnRenamed("mass", "rank")
    if steps.isEmpty():
        return ranks
    # a host without links keeps what it has: it links to itself
    hosts = ranks.select("mode", "host").union(steps.select("mode", F.col("target").alias("host"))).distinct()
    ends = hosts.join(steps.select("mode", "host").distinct(), ["mode", "host"], "left_anti")
    steps = cut(steps.unionByName(ends.select("mode", "host", F.col("host").alias("target"), F.lit(1.0).alias("share"))), "walks")
    hot = hot_keys(steps, ["mode", "host"])
    for i in range(1, iterations + 1):
        moved = joined(steps, ranks, ["mode", "host"], hot=hot).select("mode", F.col("target").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        base = start.select("mode", "host", ((1 - damping) * F.col("mass")).alias("rank"))
        ranks = moved.unionByName(base).groupBy("mode", "host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 0 or i == iterations:
            ranks = cut(ranks, "ranks")
    return ranks


def filtered(pages: DataFrame, rules=RULES, damping: float = DAMPING, iterations: int = ITERATIONS, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html)."""
    by_rule = judged(pages, rules)
    seeds = by_rule.where("by_rule is not null").groupBy(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("mode"), "host").agg(F.count("*").cast("double").alias("mass"))
    ranks = propagated(seeds, cut(host_edges(pages), "edges"), damping, iterations)
    of = lambda mode: F.coalesce(F.sum(F.when(F.col("mode") == mode, F.col("rank"))), F.lit(0.0))
    blocked = cut(ranks.groupBy("host").agg((of("distrust") > margin * of("trust")).alias("distrusted")).where("distrusted"), "blocked")
    left = joined(by_rule, blocked, ["host"], "left")
    verdict = F.coalesce("by_rule", F.when(F.col("distrusted"), "block").otherwise("allow"))
    return left.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
