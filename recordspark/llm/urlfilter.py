"""URL filters by link-graph propagation. DataFrame functions only.

A rule names a host (and its subdomains) and a path prefix, and the longest rule that fits decides. Where none fits,
the host's link neighbourhood decides: trust spreads from allowed seeds along links (personalised PageRank), distrust
from blocked seeds against them (who links to bad hosts is bad), and a host whose distrust exceeds its trust by
`threshold` of a full seed is blocked. A host's seed weight is the share of its pages that rules block (or allow).

At scale: the graph is one of hosts, not pages: links are read in the JVM, cut to the host, and made distinct before
anything is joined. Sums by host combine before they shuffle, so a host with a third of all pages is no hot key there;
the join of pages to blocked hosts is salted, and that of the flow to a hub's links is an equi join of distinct edges, which
the adaptive split takes apart. Each round of the walk is a checkpoint in the
shared folder, so a lost executor costs one round at most. The walk ends when what is left of it can't move any host
across the threshold, or can't add more than `tolerance` to any host.

Defined results: null url, or one without ://, has an empty host and path, no rule, verdict allow; null html has no
links; links in comments, scripts and styles, and other attributes than href, don't count; repeated links count once; links of
a host to itself are not edges; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

#: (verdict, rule): host up to the first /, then the path's prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: What holds no links: comments, scripts, styles; one that isn't closed goes on to the end.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
SALTS = 32
#: Rounds from one look at which hosts are undecided to the next.
CHECKED = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> F.Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url) -> F.Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules=RULES, host="host", path="path") -> F.Column:
    """struct(rule, decision) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,decision:string>")
    for decision, rule in sorted(rules, key=lambda x: len(x[1])):
        name, _, prefix = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith("/" + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(decision).alias("decision"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) host pairs of the absolute links in the pages."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.col(html_col), HIDDEN, " "), F.lit(LINK), F.lit(1)))).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-9, threshold: float | None = None) -> DataFrame:
    """edges: (src, dst); seeds: (host, trust, distrust), weights from 0 to 1. Returns (host, trust, distrust).

    Ends after `rounds` if given, else when all later flow can't add up to over `tolerance`, and with a threshold when it
    can't move distrust - trust of any host across that.

    Trust runs along edges, split over a host's out-links; distrust against them, split over its in-links. Scores are
    in units of a seed (divided by 1 - damping) and rounded, so that the order of sums can't show.
    """
    ways = edges.selectExpr("true as good", "src as here", "dst as there").unionByName(edges.selectExpr("false as good", "dst as here", "src as there"))
    degree = ways.groupBy("good", "here").agg(F.count("*").alias("degree"))
    ways = checkpointed(ways.join(degree, ["good", "here"]))
    start = seeds.select(F.explode(F.array(F.struct(F.lit(True).alias("good"), "host", F.col("trust").alias("score")), F.struct(F.lit(False).alias("good"), "host", F.col("distrust").alias("score")))).alias("s")).select("s.*").where("score > 0")
    scores = start = checkpointed(start)
    flow = start
    if not ways.isEmpty():
        # scores = sum of start's mass carried along 0, 1, 2, ... edges; flow is the last term
        for n in itertools.count(1) if rounds is None else range(1, rounds + 1):
            sent = flow.withColumnRenamed("host", "here").join(ways, ["good", "here"])
            flow = checkpointed(sent.groupBy("good", F.col("there").alias("host")).agg(F.sum(F.col("score") * damping / F.col("degree")).alias("score")).where("score > 0"))
            left = {r.good: r.score for r in flow.groupBy("good").agg(F.sum("score").alias("score")).collect()}
            if not left:
                break
            scores = checkpointed(scores.unionByName(flow).groupBy("good", "host").agg(F.sum("score").alias("score")))
            if rounds is None:
                # each further round carries at most the damped flow of the one before
                trust, distrust = (left.get(good, 0.0) * damping / (1 - damping) for good in (True, False))
                if trust + distrust <= tolerance:
                    break
                if threshold is not None and n % CHECKED == 0:
                    apart = scores.groupBy("host").agg(F.sum(F.when(F.col("good"), -F.col("score")).otherwise(F.col("score"))).alias("apart"))
                    if apart.where((F.col("apart") >= threshold - distrust - tolerance) & (F.col("apart") <= threshold + trust + tolerance)).isEmpty():
                        break
    return scores.groupBy("host").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("good") == good, F.col("score"))), F.lit(0.0)), 12).alias(name) for good, name in ((True, "trust"), (False, "distrust"))])


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5, damping: float = 0.85, rounds: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict."""
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("r", rule_of(rules))
    share = lambda what: F.avg(F.when(F.col("r.decision") == what, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(host_edges(pages, url_col, html_col), seeds, damping, rounds, threshold=threshold)
    blocked = scores.where(F.col("distrust") - F.col("trust") >= threshold).select("host", F.lit("block").alias("by_links"))
    # Salted: a host with a third of all pages is spread over SALTS tasks.
    blocked = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    return judged.join(blocked, ["host", "salt"], "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.decision", "by_links", F.lit("allow")).alias("verdict"))
