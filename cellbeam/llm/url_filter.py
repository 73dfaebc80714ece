"""URL filters: host rules first, then link-graph propagation, thresholded per host.

Trust flows from hosts with allowed pages along host edges by personalised
PageRank; distrust flows from hosts with blocked pages against them. Edges are the
absolute links between hosts, and a host with its parent domains both ways. Only
DataFrame operations: nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, shared_dir, stash

#: The rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.length(rest) + 4, F.length(url))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.length(rest) + 4, F.length(url))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out if out is not None else F.lit(None).cast("string")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, weight``: distinct links between different hosts by number, and parent domains both ways by 1.

    Links of one page count once per host; counts are summed before the shuffle, so a host with a third of all
    pages costs one row per partner and task.
    """
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), 1)
    page = pages.select(host_of(F.col(url_col)).alias("src"), F.when(F.contains(F.col(html_col), F.lit("//")), found).alias("links"))
    # a link without a scheme gets one, so that host_of fits
    targets = F.array_distinct(F.transform("links", lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))))
    links = page.select("src", F.explode(targets).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = page.select("src").where("src <> ''").groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    # m.a.example.net -> a.example.net -> example.net; the last label alone is no host
    labels = F.split("src", r"\.")
    steps = F.explode(F.when(F.size(labels) >= 3, F.sequence(F.lit(1), F.size(labels) - 2)).otherwise(F.array().cast("array<int>")))
    chain = hosts.select("src", labels.alias("l"), steps.alias("k"))
    join = lambda k: F.array_join(F.slice("l", k, F.size("l")), ".")
    family = chain.select(join(F.col("k")).alias("src"), join(F.col("k") + 1).alias("dst")).distinct()
    both = family.select("src", "dst").unionByName(family.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = 8, damping: float = 0.5, keep=None) -> DataFrame:
    """``host, trust, distrust`` after ``rounds`` of personalised PageRank, in units of the seeds.

    ``seeds``: host, trust, distrust (0 for none; every host of the graph). Trust follows the edges, distrust
    runs against them; each round is one join and one sum by host over both. ``keep`` writes a table and reads it
    back, by default below the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    along = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("weight") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
    against = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("total")).alias("d"))
    keep = keep or (lambda df: stash(df, shared_dir(df.sparkSession)))
    flow = keep(along.unionByName(against).groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    rank = seeds
    for k in range(rounds):
        moved = flow.join(rank, F.col("a") == F.col("host")).groupBy("b").agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        start = seeds.select("host", F.col("trust").alias("trust0"), F.col("distrust").alias("distrust0"))
        rank = start.join(moved, F.col("host") == F.col("b"), "left").select("host", *[((1 - damping) * F.col(f"{x}0") + damping * F.coalesce(F.col(x[0]), F.lit(0.0))).alias(x) for x in ("trust", "distrust")])
        if k % 4 == 3 and k + 1 < rounds:
            rank = keep(rank)
    return rank


def judge(pages: DataFrame, rules: dict[str, str] = RULES, rounds: int = 8, damping: float = 0.5, threshold: float = 0.2, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, host, path, rule, verdict, trust, distrust`` of every page.

    The verdict is that of the longest fitting rule. Without one, a host is blocked if its distrust exceeds its
    trust by more than ``threshold`` per page; hosts without evidence are allowed. Seeds are a host's pages that
    a rule allows or blocks, in numbers. A null url, or one without ``://``, has an empty host and path and is
    allowed; a null html has no links; repeated rows are judged alike.
    """
    spark = pages.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        return stash(df, paths[-1])

    page = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    page = page.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for kind in ("allow", "block"):
        verdicts = F.when(F.col("rule").isin([r for r, v in rules.items() if v == kind]), F.lit(kind)).otherwise(verdicts)
    page = page.withColumn("ruled", verdicts)
    hosts = page.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").cast("double").alias("trust"), F.count_if(F.col("ruled") == "block").cast("double").alias("distrust"))
    hosts = keep(hosts)
    edges = keep(host_edges(pages, url_col, html_col))
    others = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct().join(hosts, "host", "left_anti")
    seeds = hosts.select("host", "trust", "distrust").unionByName(others.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")))
    rank = propagate(keep(seeds), edges, rounds, damping, keep)
    scored = rank.join(hosts.select("host", "pages"), "host").select("host", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"), "pages")
    scored = scored.withColumn("by_links", F.when(F.col("distrust") - F.col("trust") > threshold * F.col("pages"), F.lit("block")).otherwise(F.lit("allow")))
    scored = stash(scored, shared_dir(spark))
    for path in paths:
        drop_stash(spark, path)
    return page.join(scored, "host", "left").select(id_col, "host", "path", "rule", F.coalesce("ruled", "by_links", F.lit("allow")).alias("verdict"), "trust", "distrust")
