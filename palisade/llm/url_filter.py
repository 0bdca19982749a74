"""URL filter: rules first; for other pages trust and distrust of their host, spread over the host graph.

Trust is a personalised PageRank along links, from hosts whose pages the rules allow; distrust runs against the links, from hosts whose
pages the rules block (who links to a bad host is suspect). Seeds weigh by the share of their pages that the rules decide. A host
is blocked where distrust outweighs trust. Hosts are linked by hyperlinks and to their parent domains. Joins and groupings only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import durable

_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Decides the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits; rules are few and written into the plan."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` of ``pages(host, html)``: links between different hosts, counted, and both ways between a host and its parent domain."""
    links = (pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
             .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    known = pages.filter("host <> ''").select("host").distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    names = F.split("host", "\\.")
    # a host, its parent, the parent's parent and so on down to two labels
    chain = F.when(F.size(names) > 2, F.transform(F.sequence(F.lit(1), F.size(names) - 2), lambda i: F.struct(
        F.array_join(F.slice(names, i, F.size(names)), ".").alias("low"), F.array_join(F.slice(names, i + 1, F.size(names)), ".").alias("high"))))
    family = known.select(F.explode(chain).alias("e")).select("e.low", "e.high").distinct()
    both = family.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")),
                                           F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("weight"))
    return links.unionByName(both).filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.7, tolerance: float = 1e-3, together: int = 4) -> DataFrame:
    """``host, trust, distrust`` from ``edges(src, dst, weight)`` and ``seeds(host, trust, distrust)``, each kind of seed adding up to 1.

    Both kinds take a step in one join: trust along the edges, distrust against them. ``together`` steps are one job; its result
    is written to the shared folder. Steps end when scores change by less than ``tolerance`` in all, as they must: a step shrinks
    the change by ``damping``. Scores of hosts without edges stop there.
    """
    moves = (edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight")
             .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight")))
    out = moves.groupBy("kind", "host").agg(F.sum("weight").alias("all"))
    moves = durable(moves.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("all")).alias("share")))
    start = seeds.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "score"))
    start = durable(start.filter("score > 0"))
    restart = start.withColumn("score", F.col("score") * (1 - damping))
    now = start
    while True:
        after = now
        for _ in range(together):
            flow = (after.join(moves, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")))
            after = flow.unionByName(restart.select("kind", "host", "score")).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        after = durable(after)
        change = (after.select("kind", "host", "score").unionByName(now.select("kind", "host", (-F.col("score")).alias("score")))
                  .groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d")).agg(F.sum("d")).first()[0])
        now = after
        if (change or 0) < tolerance:
            break
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(score("trust"), score("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages(page_id, url, html, ...)``.

    The verdict is the rule's; without one a host is blocked if distrust is more than ``threshold`` of its trust and distrust
    together, and allowed else, so also where neither reaches it. Urls that are null or have no ``://`` have empty host and path
    and are allowed; a null html has no links. Equal rows are judged alike; an empty table gives no rows. Other columns are not looked at.
    """
    url = F.col("url").cast("string")
    named = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ruled = named.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules, lambda r: r.name),
                               "by_rule": rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict)})
    share = lambda v: F.avg((F.coalesce(F.col("by_rule") == v, F.lit(False))).cast("double"))
    seeds = durable(ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    total = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    seeds = seeds.select("host", *((F.col(c) / F.lit(float(t or 1) or 1.0)).alias(c) for c, t in zip(("trust", "distrust"), total)))
    scores = propagate(host_edges(named.select("host", "html")), seeds)
    judged = ruled.drop("html").join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
