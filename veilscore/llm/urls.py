"""URL filters: host rules, then trust and distrust over the link graph of hosts.

Trust starts at hosts by the share of their pages that a rule allows and flows
along links (personalised PageRank); distrust starts by the share that a rule
blocks and flows against links: who links to blocked hosts is distrusted.  Both
run in Spark over deduplicated host edges, one written table per iteration, until
nothing moves any more.  Pages that no rule decides get their host's verdict: a
host is blocked when distrust makes up more than ``MAX_DISTRUST`` of the two
(a host with neither is allowed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import released, stored

DAMPING = 0.85
MAX_DISTRUST = 0.5
#: Turns after which unsettled scores are an error.
MAX_ITERATIONS = 1000
#: Greatest move of a score, relative to the score itself: verdicts compare scores of
#: any size.  A host that a turn reaches first moves by its whole score.
TOLERANCE = 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative targets of anchors.
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``(page_id, host, path, links)``; links are distinct other hosts."""
    url, host = F.col(url_col), host_of(F.col(url_col))
    targets = F.transform(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(_LINK), F.lit(1)),
                          lambda x: F.translate(x, _UPPER, _LOWER))
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path_of(url).alias("path"),
                        F.array_distinct(targets).alias("links"))


def host_rules(spark: SparkSession, hosts: DataFrame, rules: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Hosts with the rules of themselves and all parent domains, longest first."""
    listed = [F.struct(F.lit(h).alias("suffix"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"),
                       F.lit(a).alias("allow")) for h, p, a in rules]
    kind = "array<struct<suffix:string,path:string,rule:string,allow:boolean>>"
    table = spark.range(1).select(F.inline(F.array(*listed).cast(kind)))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (hosts.withColumn("suffix", F.explode(suffixes)).join(table, "suffix")
             .withColumn("entry", F.struct(-F.length("rule"), "path", "rule", "allow")))
    return found.groupBy("host").agg(F.sort_array(F.collect_list("entry")).alias("rules"))


def _first_rule() -> Column:
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    return F.get(fits, F.lit(0))


def link_scores(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``(host, trust, distrust)`` from ``seeds(host, good, bad)`` and
    ``edges(source, target, weight)``."""
    out_weight = edges.groupBy("source").agg(F.sum("weight").alias("all"))
    in_weight = edges.groupBy("target").agg(F.sum("weight").alias("all"))
    forward = edges.join(out_weight, "source").select(
        F.lit("trust").alias("kind"), "source", "target", (F.col("weight") / F.col("all")).alias("share"))
    backward = edges.join(in_weight, "target").select(
        F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"),
        (F.col("weight") / F.col("all")).alias("share"))
    flow = stored(forward.union(backward), "urls-flow")
    start = stored(seeds.select(F.lit("trust").alias("kind"), "host", F.col("good").alias("seed"))
                   .union(seeds.select(F.lit("distrust").alias("kind"), "host", F.col("bad").alias("seed")))
                   .filter("seed > 0"), "urls-seeds")
    rank = stored(start.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("rank")), "urls-rank")
    for _ in range(MAX_ITERATIONS):
        passed = flow.join(rank, (flow.kind == rank.kind) & (flow.source == rank.host)).select(
            flow.kind, F.col("target").alias("host"), (F.lit(DAMPING) * F.col("share") * F.col("rank")).alias("rank"))
        kept = start.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("rank"))
        after = stored(passed.union(kept).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "urls-rank")
        moved = after.withColumnRenamed("rank", "now").filter("now > 0").join(rank, ["kind", "host"], "left").agg(
            F.max(F.abs(F.col("now") - F.coalesce("rank", F.lit(0.0))) / F.col("now"))).first()[0]
        released(rank)
        rank = after
        if (moved or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError("link scores did not settle")
    return rank.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, bool]], id_col: str = "page_id",
           url_col: str = "url", html_col: str = "html", max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)``, one row per input row.

    ``rules`` are (host, path, allow); a rule fits its host and all subdomains if
    the page's path starts with the rule's, the longest one wins and is named
    ``host + path``.  Null urls and urls without ``://`` have an empty host and
    path, no rule and no links counted, and are allowed.  Null pages have no
    links; repeated rows are judged alike and weigh in their host's shares and
    links; an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = stored(parsed(pages, id_col, url_col, html_col), "urls-pages")
    hosts = rows.select("host").distinct()
    rulings = stored(host_rules(spark, hosts.filter("host <> ''"), rules), "urls-rules")
    first = _first_rule()
    ruled = rows.drop("links").join(rulings, "host", "left").withColumn("first", first)
    seeds = ruled.groupBy("host").agg(
        F.avg(F.when(F.col("first.allow"), 1.0).otherwise(0.0)).alias("good"),
        F.avg(F.when(~F.col("first.allow"), 1.0).otherwise(0.0)).alias("bad"))
    edges = stored(rows.filter("host <> ''").select(F.col("host").alias("source"), F.explode("links").alias("target"))
                   .filter("source <> target").groupBy("source", "target")
                   .agg(F.count(F.lit(1)).cast("double").alias("weight")), "urls-edges")
    scores = link_scores(stored(seeds, "urls-shares"), edges)
    table = stored(hosts.join(rulings, "host", "left").join(scores, "host", "left")
                   .select("host", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"),
                           F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "urls-hosts")
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    trusted = F.when(F.col("trust") + F.col("distrust") > 0, share <= max_distrust).otherwise(True)
    allow = F.coalesce(F.col("first.allow"), trusted)
    return (rows.drop("links").join(table, "host").withColumn("first", first)
            .select("page_id", "host", "path", F.col("first.rule").alias("rule"),
                    F.when(allow, "allow").otherwise("block").alias("verdict"), "trust", "distrust"))
