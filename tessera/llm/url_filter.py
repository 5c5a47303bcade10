"""URL rules with redirect equivalence.

Pages that redirect to each other or name each other as canonical are aliases.
A block rule that fits one url of such a component blocks all of it, except
urls that an allow rule fits themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_PARTS, join_groups, split_join, written
from .components import connected_components

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(None).cast("string"))


def host_of(url: Column) -> Column:
    """Between ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"\A([^/?#]*)", 1), AZ, az), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """What identifies a page: host, path and query, without scheme or fragment; null if there is no host."""
    query = F.regexp_extract(url, r"\A[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def resolve(base: Column, link: Column) -> Column:
    """An absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"\A([^:/?#]*)://", 1)
    folder = F.regexp_extract(path_of(base), r"\A(.*/)", 1)
    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host_of(base), link))
        .when(F.length(link) > 0, F.concat(scheme, F.lit("://"), host_of(base), F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) url keys: canonical links and immediate refreshes of each page's html."""
    tag = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), F.lit(0)))
    tags = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", tag.alias("tag"))
    q = "[\"']?"
    canonical = F.when(F.col("tag").rlike(rf"(?i)\srel\s*=\s*{q}canonical\b"), F.regexp_extract("tag", rf"(?i)\shref\s*=\s*{q}([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(rf"(?i)\shttp-equiv\s*=\s*{q}refresh\b"), F.regexp_extract("tag", r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1))
    # exploding one-element arrays keeps the nested expressions from being inlined into each other
    links = tags.select("url", F.explode(F.array(F.coalesce(canonical, refresh))).alias("link")).where("link <> ''")
    links = links.select("url", F.explode(F.array(resolve(F.col("url"), F.col("link")))).alias("target"))
    return links.select(url_key(F.col("url")).alias("src"), url_key(F.col("target")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (length, rule, verdict) of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    known = F.array(*[
        F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(what).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
        for what, h, p in rules
    ])
    fits = F.filter(known, lambda r: F.concat(F.lit("."), host).endswith(F.concat(F.lit("."), r["host"])) & path.startswith(r["path"]))
    return F.array_max(fits)


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of ``pages``.

    ``redirects`` (from_url, to_url) adds known redirects to the links found in
    the html.  A null url, or one without ``://``, has an empty host and path,
    fits no rule, has no aliases and is allowed.  Repeated pages are judged
    alike, each in a row of its own; an empty table gives an empty result.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("from_url")).alias("src"), url_key(F.col("to_url")).alias("dst")).where("src <> dst")).distinct()
    edges = written(edges, "url-edges")
    parts = connected_components(edges)

    # an alias need not be a page itself: rules are asked of every url in a component
    node_host, node_path = F.regexp_extract("node", r"\A([^/?#]*)", 1), F.regexp_extract("node", r"\A[^/?#]*([^?#]*)", 1)
    blocks = F.coalesce(best_rule(node_host, node_path, rules)["verdict"] == "block", F.lit(False))
    whole = written(parts.groupBy("component").agg(F.max(blocks).alias("alias_blocked"), F.count(F.lit(1)).alias("members")), "url-components")
    parts = written(join_groups(parts, whole, "component", "members", "inner").select("node", "component", "alias_blocked"), "url-parts")

    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("node"))
    best = best_rule(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("best", best).select("*", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("own"))
    # pages without a host have no aliases; urls of many pages, with aliases or not, meet their component by broadcast
    named = seen.where("node IS NOT NULL")
    floor = max(pages.count() // HOT_PARTS, 1000)
    often = written(named.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor).select("node"), "url-often")
    few = F.broadcast(parts.join(F.broadcast(often), "node", "left_semi"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in parts.dtypes if c != "node"]
    out = split_join(named, "node", F.broadcast(often), parts, few, "left").unionByName(seen.where("node IS NULL").select("*", *none))
    final = F.coalesce(F.col("own"), F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), F.coalesce("component", "node").alias("component"))
