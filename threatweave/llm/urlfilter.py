"""URL filters: host and path rules, and aliases that share a page's decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatweave.llm.common import bind, settle
from threatweave.llm.components import connected_components

# (verdict, host, path): a rule fits its host and all subdomains, below its path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as ``struct<rule, verdict>``, null if none; of equal rules allow wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    table = F.array(*[F.struct(
        F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"),
    ) for v, h, p in ordered])
    fits = F.filter(table, lambda r: F.startswith(path, r["path"]) & (
        (host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))))
    return bind(F.get(fits, F.lit(0)), lambda r: F.when(
        r.isNotNull(), F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def node_of(url: Column) -> Column:
    """A url as a node: scheme and host lower-cased, no fragment; null for what is no url."""
    scheme = F.translate(F.regexp_extract(url, "(?s)^(.*?)://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def _absolute(target: Column, url: Column) -> Column:
    """``target`` as seen from the page at ``url``."""
    scheme = F.regexp_extract(url, "(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (
        F.when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def _resolved(url: Column) -> Column:
    """``url`` without ``.`` and ``..`` segments in its path."""
    steps = F.split(path_of(url), "/", -1)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(
        s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(s))))
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    path = F.concat(F.array_join(kept, "/"), ends)
    return F.when(path_of(url).rlike("/\\.{1,2}(/|$)"), F.concat(
        F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1), path,
        F.regexp_extract(url, "(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1))).otherwise(url)


def page_links(pages: DataFrame) -> DataFrame:
    """``u, v``: redirect (meta refresh) and canonical-link edges between url nodes, read from whole pages."""
    html = F.col("html")
    tags = F.when(html.rlike("(?i)canonical|http-equiv"), F.regexp_extract_all(
        html, F.lit("(?is)<(?:link|meta)\\b[^>]*>"), F.lit(0)))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike("(?is)^<link\\b") & t.rlike("(?is)\\brel\\s*=\\s*[\"']?canonical\\b")),
        lambda t: F.regexp_extract(t, "(?is)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", 1))
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike("(?is)^<meta\\b") & t.rlike("(?is)\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b")),
        lambda t: F.regexp_extract(t, "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)", 1))
    target = F.regexp_replace("target", "(?i)&amp;", "&")
    return (
        pages.where(F.contains("url", F.lit("://"))).select("url", F.explode(F.concat(canonical, refresh)).alias("target"))
        .where(F.col("target") != "")
        .select(node_of(F.col("url")).alias("u"), node_of(_resolved(_absolute(target, F.col("url")))).alias("v"))
        .where("u != v").distinct()
    )


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``.

    The longest rule that fits decides. Other urls take the decision of their aliases:
    urls joined by redirects or canonical links, over any number of steps, are one
    component; a rule that allows a member outranks one that blocks a member. A url
    without rule and without decided alias is allowed. Link targets that are not pages
    count as members. ``redirects`` (``src, dst``) adds known redirects to those in the pages.

    A null url, or one without ``://``, has empty host and path, no rule and no
    aliases. Null html has no links. Repeated rows come back each. ``rules`` is a
    parameter list and travels in the plan.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(
            node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v")).where("u != v"))
    comps = settle(connected_components(links), "url-components")
    ruled = comps.withColumn("verdict", matching_rule(
        host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    decided = settle(ruled.groupBy("comp").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"),
    ).where("allowed OR blocked").select("comp", F.when(F.col("allowed"), "allow").otherwise("block").alias("alias")),
        "url-decisions")
    alias = settle(comps.join(decided, "comp").select("node", "alias"), "url-aliases")
    url = F.col("url")
    rows = pages.select(
        "page_id", node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    return rows.join(alias, "node", "left").select(
        "page_id", "host", "path", "rule.rule",
        F.coalesce("rule.verdict", "alias", F.lit("allow")).alias("verdict"))
