"""URL filter by rules and link-graph propagation (DataFrame functions only).

Rules name a host and a path prefix and fit the host with all its subdomains;
the longest fitting rule decides a page. Other pages get their host's verdict.

Hosts are nodes. A link in a page's html is an edge from the page's host to the
link's host, weighted by the number of such links; a host and its parent domain
are linked both ways where both are nodes (``site_edges``). Trust is personalised
PageRank: it restarts at hosts in proportion to their pages that a rule allows
and follows the links. Distrust restarts at hosts in proportion to their pages
that a rule blocks and follows the links backwards, from a target to those who
link to it. A host is blocked if its distrust exceeds ``ratio`` times its trust.

A host without links to follow hands its mass back to the seeds: the fixed point
of that walk is the one without, divided by its sum, so the ranks are scaled to
sum 1 at the end. Steps go on until the ranks change by less than ``tolerance``
in all; each step shrinks the change by the damping factor at least, so the loop
ends.

Edges are combined per host pair before they move, so their number is that of
linked host pairs; ranks live in a table with a row a host. A step is one join
and one sum, with reliable checkpoints every few steps. Sums are grouped by the
host and its hash, so that their exchange does not serve the join that follows
and adaptive execution can split the partition of a hot host there; the same
holds for the join that hands scores to pages.

Defined cases: a null url, or one without ``://``, has empty host and path, no
rule, and the verdict allow, as has any host without evidence. Null html has no
links. Without seeds all scores are 0. Repeated pages count as pages. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

# Verdict, host, path prefix.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DAMPING, TOLERANCE, RATIO = 0.85, 1e-4, 1.0
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer ones take precedence
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between hosts and within them. pages: host, html."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))

    def target_host(t):
        absolute = F.regexp_extract(t, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
        return F.when(absolute != "", ascii_lower(absolute)).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).otherwise(F.col("host"))

    each = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.transform(targets, target_host)).alias("dst"))
    return each.where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagate(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, every: int = 6) -> DataFrame:
    """(host, trust, distrust) of every host that mass reaches. nodes: host, good, bad (seed weights); edges: src, dst, w between nodes."""
    total = nodes.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    share = lambda c, n: F.col(c) / F.lit(float(n)) if n else F.lit(0.0)
    seeds = cut(nodes.where("good > 0 or bad > 0").select("host", share("good", total.g).alias("trust"), share("bad", total.b).alias("distrust")))
    out = edges.groupBy("src", F.xxhash64("src")).agg(F.sum("w").alias("out")).select(F.col("src").alias("s"), "out")
    into = edges.groupBy("dst", F.xxhash64("dst")).agg(F.sum("w").alias("into")).select(F.col("dst").alias("d"), "into")
    weighed = edges.join(out, F.col("src") == F.col("s")).join(into, F.col("dst") == F.col("d"))
    forward = weighed.select(F.col("src").alias("frm"), F.col("dst").alias("to"), (F.col("w") / F.col("out")).alias("ft"), F.lit(0.0).alias("fb"))
    backward = weighed.select(F.col("dst").alias("frm"), F.col("src").alias("to"), F.lit(0.0).alias("ft"), (F.col("w") / F.col("into")).alias("fb"))
    arcs = cut(forward.union(backward).groupBy("frm", "to").agg(F.sum("ft").alias("ft"), F.sum("fb").alias("fb")))
    summed = lambda df: df.groupBy("host", F.xxhash64("host")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).select("host", "trust", "distrust")
    restart = seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    ranks = seeds
    while total.g or total.b:
        held = ranks
        for _ in range(every):
            sent = arcs.join(ranks, F.col("frm") == F.col("host")).select(F.col("to").alias("host"), (damping * F.col("ft") * F.col("trust")).alias("trust"), (damping * F.col("fb") * F.col("distrust")).alias("distrust"))
            ranks = summed(sent.union(restart))
        ranks = cut(ranks)
        # the change over `every` steps bounds that of one
        both = ranks.union(held.select("host", -F.col("trust"), -F.col("distrust")))
        change = both.groupBy("host").agg(F.abs(F.sum("trust")).alias("t"), F.abs(F.sum("distrust")).alias("b")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).first()
        if max(change.t, change.b) < tolerance:
            break
    sums = ranks.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("b")).first()
    scaled = lambda c, n: (F.col(c) / F.lit(float(n)) if n else F.lit(0.0)).alias(c)
    return ranks.select("host", scaled("trust", sums.t), scaled("distrust", sums.b))


def judge_pages(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, ratio: float = RATIO, site_edges: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    parsed = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("__r", longest_rule(F.col("host"), F.col("path"), rules))
    hit = lambda v: F.sum(F.when(F.col("__r.verdict") == v, 1.0).otherwise(0.0))
    own = parsed.drop("html").where("host <> ''").groupBy("host").agg(hit("allow").alias("good"), hit("block").alias("bad"))
    links = cut(link_edges(parsed))
    nodes = cut(own.union(links.select("dst", F.lit(0.0), F.lit(0.0))).groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad")))
    if site_edges:
        up = nodes.select(F.col("host").alias("c"), F.regexp_replace("host", r"^[^.]*\.", "").alias("p")).where("p <> c and contains(p, '.')")
        up = up.join(nodes.select(F.col("host").alias("n")), F.col("p") == F.col("n"), "left_semi")
        links = cut(links.union(up.select("c", "p", F.lit(1.0))).union(up.select("p", "c", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    scores = propagate(nodes, links, damping, tolerance)
    # rounded: sums in another order must not turn a tie
    blocked = F.round(F.col("distrust"), 12) > F.round(F.lit(ratio) * F.col("trust"), 12)
    judged = scores.select(F.col("host").alias("h"), "trust", "distrust", blocked.alias("blocked"))
    thin = parsed.select("page_id", "host", "path", "__r")
    out = thin.join(judged, F.col("host") == F.col("h"), "left")
    method = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), F.coalesce(F.col("__r.verdict"), method).alias("verdict"), zero("trust"), zero("distrust"))
