"""URL filters: explicit host/path rules, and for the rest a verdict per host by link-graph propagation.

Trust is personalised PageRank from trusted hosts along the links; distrust is personalised PageRank from blocked
hosts against them (who links to a blocked host is suspect). A host is blocked where its distrust exceeds
`threshold` times its trust plus distrust. The graph is held as (source host, target host, share) rows; each round
is one join and one aggregation with map-side sums, and what moved is written.

Seeds come from the rules: a host is trusted where rules allow pages of it and block none; it is blocked where they
block the greater part of its pages. A host that neither seed reaches is allowed.

A null url, or one without "://", has an empty host and path; no rule fits it, and it is allowed. Pages without html
give no links; long ones are read whole. Repeated rows are judged alike, and their links count once more each. Of rules of equal
length that fit, the later of the list wins; a host whose distrust equals its share exactly is allowed. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.session import written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING, THRESHOLD = 0.85, 0.5
#: So many rounds that the mass still on its way is at most a thousandth.
ROUNDS = math.ceil(math.log(1e-3) / math.log(DAMPING))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and ruled (its verdict). rules: a short list."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return out.withColumns({"rule": rule, "ruled": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, share: links between different hosts, each host's shares summing to 1."""
    links = pages.where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
    full = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    counted = links.select("src", host_of(full).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").count()
    total = counted.groupBy("src").agg(F.sum("count").alias("of"))
    return counted.join(total, "src").select("src", "dst", (F.col("count") / F.col("of")).alias("share"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, rank: personalised PageRank. edges: src, dst, share; seeds: host, weight (summing to 1). Mass of hosts
    without links returns to the seeds."""
    rank = seeds.select("host", F.col("weight").alias("rank"))
    for _ in range(rounds):
        moved = written(rank.join(edges, rank["host"] == edges["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank")), "rank")
        back = 1.0 - float(moved.agg(F.sum("rank")).first()[0] or 0.0)
        rank = moved.unionByName(seeds.select("host", (F.col("weight") * back).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
    return rank


def host_scores(edges: DataFrame, trusted: DataFrame, blocked: DataFrame, **how: float) -> DataFrame:
    """host, trust, distrust. trusted, blocked: host (distinct); each side's ranks are scaled to its number of seeds."""
    sides = []
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    into = back.groupBy("src").agg(F.sum("share").alias("of"))
    back = back.join(into, "src").select("src", "dst", (F.col("share") / F.col("of")).alias("share"))
    linked = not edges.isEmpty()
    for seeds, graph, name in ((trusted, edges, "trust"), (blocked, written(back, "edges") if linked else back, "distrust")):
        n = seeds.count()
        weighted = seeds.select("host", F.lit(1.0 / max(n, 1)).alias("weight"))
        ranks = spread(graph, weighted, **how) if linked and n else weighted.withColumnRenamed("weight", "rank")
        sides.append(ranks.select("host", (F.col("rank") * n).alias(name)))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return sides[0].join(sides[1], "host", "full").select("host", zero("trust"), zero("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    rows = ruled(pages.select("page_id", "url"), rules)
    by_host = written(
        rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("n_block"), F.count_if(F.col("ruled") == "allow").alias("n_allow")), "hosts"
    ).where("host <> ''")
    scores = host_scores(written(host_edges(pages), "edges"), by_host.where("n_allow > 0 AND n_block = 0").select("host"), by_host.where("2 * n_block > n").select("host"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.join(scores, "host", "left").withColumns({"trust": zero("trust"), "distrust": zero("distrust")})
    suspect = (F.col("distrust") > 0) & (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(suspect, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
