"""URL filters: rules, and trust and distrust spread over the host link graph.

A page's host and path are matched with a short list of rules. Hosts whose pages the rules
allow seed trust, hosts whose pages they block seed distrust, each by the share of its pages.
Trust follows links by personalised PageRank; distrust follows them backwards, so that a host
linking to blocked ones becomes suspect. A host is blocked where distrust is at least
``BLOCK_SHARE`` of the two; a host without links is judged by its own pages alone. Both are
returned scaled to sum to one. Rules come before the host's verdict, and hosts that differ in
user part or port only are one host of the graph.

Defined results: a NULL url, or one without ``://``, has an empty host and path and belongs to
the empty host, which no link reaches; hosts that neither reaches (scores below the smallest
double count as none, some thousand links from a seed) are allowed; repeated rows
are judged alike (a page counts as often as it occurs); a NULL html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage_shared

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DAMPING, TOLERANCE = 0.85, 1e-4
BLOCK_SHARE = 0.8
_LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def node(host: Column) -> Column:
    """The host's place in the link graph: without user part and port."""
    return F.regexp_replace(host, r"^.*@|:\d*$", "")


def _match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, node, path, rule, ruled, links) staged: the html is read once."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").alias("_html"))
    links = F.transform(F.regexp_extract_all(F.coalesce("_html", F.lit("")), F.lit(_LINK), 1),
                        lambda x: node(ascii_lower(x)))
    hit = _match(F.col("host"), F.col("path"), rules)
    df = df.withColumn("node", node(F.col("host")))
    return stage_shared(df.select("page_id", "host", "node", "path", hit.alias("_m"), F.array_remove(links, F.col("node")).alias("links"))
                        .select("page_id", "host", "node", "path", F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("ruled"), "links"),
                        "pages")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) links between different hosts."""
    return (pages.select(F.col("node").alias("src"), F.explode("links").alias("dst"))
            .filter("src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n")))


def seeds(pages: DataFrame) -> DataFrame:
    """(kind, host, seed): the share of a host's pages that rules allow and block."""
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    per = pages.filter("node <> ''").groupBy(F.col("node").alias("host")).agg(share("allow").alias("a"), share("block").alias("b"))
    both = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("a").alias("seed")),
                             F.struct(F.lit("distrust").alias("kind"), F.col("b").alias("seed"))))
    return per.select("host", both.alias("s")).select("s.kind", "host", "s.seed").filter("seed > 0")


def spread(edges: DataFrame, start: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): personalised PageRank of the seeds, along the links for trust and
    against them for distrust. Mass of hosts without links returns to the seeds, which only
    scales the scores; here it is left out, so a score does not depend on how many seeds there
    are elsewhere.

    Scores start at the seeds' own part and only grow, so rounds go on until no host's score
    grows by more than ``tolerance`` of itself: a host just reached has grown from nothing, and
    once no host grows more, none does later. Only hosts with links take part in the rounds;
    a seed without any has its own part for good."""
    out_n = edges.groupBy("src").agg(F.sum("n").alias("t"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("t"))
    along = edges.join(out_n, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"),
                                            (F.col("n") / F.col("t")).alias("w"))
    against = edges.join(in_n, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"),
                                             (F.col("n") / F.col("t")).alias("w"))
    walk = stage_shared(along.unionAll(against), "walk")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    start = stage_shared(start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("own"))
                         .join(linked.withColumn("_in", F.lit(True)), "host", "left")
                         .select("kind", "host", "own", F.col("_in").isNotNull().alias("linked")), "seeds")
    alone = start.filter("NOT linked").select("kind", "host", F.col("own").alias("score"))
    start = start.filter("linked").select("kind", "host", "own")
    rank = start.withColumnRenamed("own", "score")
    moved = 1.0 if not walk.isEmpty() else 0.0
    while moved > tolerance:
        flow = rank.join(walk, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(
            (damping * F.sum(F.col("score") * F.col("w"))).alias("add"))
        parts = (start.select("kind", "host", F.col("own").alias("new"), F.lit(0.0).alias("old"))
                 .unionAll(flow.select("kind", "host", F.col("add").alias("new"), F.lit(0.0).alias("old")))
                 .unionAll(rank.select("kind", "host", F.lit(0.0).alias("new"), F.col("score").alias("old"))))
        both = stage_shared(parts.groupBy("kind", "host").agg(F.sum("new").alias("score"), F.sum("old").alias("old"))
                            .filter("score > 0"), "ranks")
        moved = both.agg(F.max(F.abs(F.col("score") - F.col("old")) / F.col("score"))).first()[0] or 0.0
        rank = both.select("kind", "host", "score")
    return rank.unionAll(alone)


def host_verdicts(scores: DataFrame, block_share: float = BLOCK_SHARE) -> DataFrame:
    """(host, trust, distrust, host_verdict) of the hosts that a seed reaches: the verdict by
    the scores as they are, and each kind scaled to sum to one."""
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    per = scores.groupBy("host").agg(part("trust").alias("_t"), part("distrust").alias("_d"))
    suspect = F.col("_d") >= block_share * (F.col("_t") + F.col("_d"))
    total = part("trust").alias("t"), part("distrust").alias("d")
    per = per.withColumn("_all", scores.agg(*total).select(F.struct("t", "d")).scalar())
    share = lambda k: F.coalesce(F.try_divide(f"_{k}", F.col("_all")[k]), F.lit(0.0))
    return per.select("host", share("t").alias("trust"), share("d").alias("distrust"),
                      F.when(suspect, "block").otherwise("allow").alias("host_verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, block_share: float = BLOCK_SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    read = parsed(pages, rules)
    hosts = host_verdicts(stage_shared(spread(host_edges(read), seeds(read)), "scores"), block_share)
    return (read.join(hosts.withColumnRenamed("host", "node"), "node", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", "host_verdict", F.lit("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
