"""URL filters: explicit rules, and trust carried over the link graph between hosts.

Rules decide first (the longest that fits). Elsewhere the host's standing decides: trust flows
from trusted hosts along links (personalised PageRank), distrust flows from blocked hosts
against the links, to those that link to them. Seeds are the hosts of which the rules allow
(or block) more than SEED_SHARE of the urls, weighted by that share. A host is blocked if its distrust
exceeds ``threshold`` of both together; without either it is allowed.

Hosts are linked by the absolute links of their pages and, both ways, to the nearest
host that they are a subdomain of and that occurs (``parents``). A link's weight is its share
of the links of the host that it leaves.

Scale: links are aggregated to host edges before anything else; each round is a join on the source
host and an aggregation that combines before its shuffle, so a hub of many links costs one row
a neighbour. Ranks are written to the shared folder every few rounds.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule, and is allowed.
Null html has no links. Repeated rows count once each. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import stored

#: (host, path, verdict): a rule fits its host and all subdomains, for paths that start so.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DAMPING, ROUNDS, THRESHOLD = 0.85, 20, 0.5
SEED_SHARE = 0.5
STORE_EVERY = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of an url."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host and path) that fits, else nulls; equal lengths: the first given."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, parents: bool = True) -> DataFrame:
    """(src, dst, weight) of distinct hosts; a source's weights add up to 1."""
    links = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([a-z][a-z0-9+.-]*://[^"']*)"""), F.lit(1)))
    found = pages.select(parts(F.col("url"))[0].alias("src"), links.alias("to")).select("src", parts(F.col("to"))[0].alias("dst"))
    edges = found.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    if parents:
        hosts = pages.select(parts(F.col("url"))[0].alias("host")).where("host != ''").distinct()
        labels = F.split("host", r"\.")
        above = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda k: F.array_join(F.slice(labels, k, F.greatest(F.size(labels) - k + 1, F.lit(0))), "."))).alias("far", "above"))
        near = above.join(hosts.select(F.col("host").alias("above")), "above").groupBy("host").agg(F.min(F.struct("far", "above"))["above"].alias("above"))
        edges = edges.unionByName(near.select(F.col("host").alias("src"), F.col("above").alias("dst"), F.lit(1.0).alias("n"))).unionByName(near.select(F.col("above").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("n")))
    edges = edges.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    return edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def flow(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, rank) of personalised PageRank over edges(kind, src, dst, weight) from seeds(kind, host, seed).

    Every kind is a graph of its own with seeds that add up to 1, and all take the same rounds. Rank
    that reaches a host without links returns to the seeds: that only scales the ranks, so it is done
    once, at the end, by making those of each kind add up to 1.
    """
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("base")).where("base > 0")
    ranks = start.select("kind", "host", F.col("base").alias("rank"))
    for k in range(rounds):
        at = ranks.select("kind", F.col("host").alias("src"), "rank")
        moved = at.join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("weight") * damping).alias("rank"))
        ranks = moved.union(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % STORE_EVERY == STORE_EVERY - 1 or k + 1 == rounds:
            ranks = stored(ranks, "urls-ranks")
    total = F.broadcast(ranks.groupBy("kind").agg(F.sum("rank").alias("total")))
    return ranks.join(total, "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("rank"))


def host_standing(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, parents: bool = True) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches."""
    forward = stored(host_edges(pages, parents), "urls-edges")
    host, path = parts(F.col("url"))
    ruled = pages.select(host.alias("host"), rule_of(host, path, rules)[1].alias("v")).where("host != ''")
    sure = lambda v: F.avg(F.col("v").eqNullSafe(v).cast("double"))
    votes = stored(ruled.groupBy("host").agg(*(F.when(sure(v) > SEED_SHARE, sure(v)).otherwise(0.0).alias(v) for v in ("allow", "block"))), "urls-votes")
    sums = votes.agg(*(F.coalesce(F.sum(v), F.lit(0.0)) for v in ("allow", "block"))).first()
    into = forward.groupBy("dst").agg(F.sum("weight").alias("all"))
    against = forward.join(into, "dst").select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("weight"))
    edges = stored(forward.select(F.lit("allow").alias("kind"), "src", "dst", "weight").union(against), "urls-both")
    seeds = [votes.select(F.lit(v).alias("kind"), "host", (F.col(v) / max(sums[k], 1e-300)).alias("seed")) for k, v in enumerate(("allow", "block"))]
    ranks = flow(edges, seeds[0].union(seeds[1]), damping, rounds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each row of pages."""
    standing = stored(host_standing(pages, rules), "urls-standing")
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).join(standing, "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    trust, distrust = (F.coalesce(x, F.lit(0.0)) for x in ("trust", "distrust"))
    own = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
