"""URL filters that see through redirects: a decision on one address holds for its aliases.

Addresses are nodes: lower-cased host, path and query, without scheme and fragment. Edges are canonical links,
immediate redirects written in the page (`meta refresh`), redirects from a table, and the step from an address
to its own normal form (no tracking parameters, no trailing slash). Connected components of these edges are
groups of aliases. A page's own rule always counts. Without one, an explicit allow anywhere among its aliases
comes before a block; with neither, the page is allowed.

Only DataFrame operations run. A null address, or one without `://`, has empty host and path, no rule and no
aliases. Repeated pages get equal results. Other columns are dropped. Rules are a table with any number of rows;
several that fit a page equally well and differ count as allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquarry.llm.components import components
from clipquarry.llm.shared import landed
from clipquarry.skew import salted_join

ALLOW, BLOCK = "allow", "block"
TRACKING = r"(?i)^(utm_\w*|gclid|fbclid|ref)="

# Whole tags and the values in them; attribute values may stand in either quotes or in none.
LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH_URL = r"(?is)\bcontent\s*=\s*[\"']?\s*0*\s*[;,]\s*url\s*=\s*[\"']?([^\"'>\s]+)"


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?` or `#`, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?` or `#`; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)


def address(url: Column) -> Column:
    """The node of a url: host, path and query; null without a host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query_of(url)))


def normal_form(node: Column) -> Column:
    """The address without tracking parameters and trailing slash."""
    path = F.regexp_replace(F.substring_index(node, "?", 1), r"/+$", "")
    tail = F.when(F.contains(node, F.lit("?")), F.regexp_replace(node, r"(?s)^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.filter(F.split(tail, "&"), lambda p: ~p.rlike(TRACKING) & (p != ""))
    return F.when(F.size(kept) > 0, F.concat_ws("?", path, F.array_join(kept, "&"))).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a full url, relative to the page's; null if empty."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(target.isNull() | (target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def _tag_value(html: Column, hint: str, tag: str, value: str, groups: int) -> Column:
    """The first value in the first such tag. Pages without the hint, nearly all, skip the slow pattern."""
    found = F.regexp_extract(html, tag, 0)
    values = [F.nullif(F.regexp_extract(found, value, g), F.lit("")) for g in range(1, groups + 1)]
    return F.when(F.contains(F.lower(html), F.lit(hint)), F.trim(F.coalesce(*values)))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between addresses, from pages (url, html) and redirects (from_url, to_url)."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    targets = F.array(
        address(resolved(_tag_value(html, "canonical", LINK_TAG, HREF, 3), url)),
        address(resolved(_tag_value(html, "http-equiv", META_TAG, REFRESH_URL, 1), url)),
        normal_form(address(url)),
    )
    edges = pages.select(address(url).alias("a"), F.explode(targets).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b")))
    edges = edges.filter("a is not null and b is not null")
    ends = edges.select(F.explode(F.array("a", "b")).alias("a"))
    normal = ends.select("a", normal_form(F.col("a")).alias("b"))
    return edges.unionByName(normal).filter("a <> b").distinct()


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) with (rule, verdict) of the longest rule that fits; others are left out.

    Each host is listed with its parent domains, which meet the rules by equality.
    """
    known = rules.select(
        F.col("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = addresses.filter("host <> ''").select("host", "path").distinct()
    fits = (
        hosts.withColumn("rule_host", F.explode(domains))
        .join(known, "rule_host")
        .filter(F.expr("startswith(path, rule_path)"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
    )
    longest = F.max(F.struct(F.length("rule").alias("size"), (F.col("rule_verdict") == ALLOW).alias("open"), "rule")).alias("best")
    best = fits.groupBy("host", "path").agg(longest)
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.open"), ALLOW).otherwise(BLOCK).alias("ruled"))


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_group) for every page; rules are (host, path, verdict). A group is
    named by its first address."""
    edges = landed(alias_edges(pages, redirects), "aliases")
    members = components(edges, "a", "b")
    names = members.groupBy("component").agg(F.min("node").alias("name"))
    groups = landed(members.join(names, "component").select("node", F.col("name").alias("component")), "groups")
    url = F.col("url").cast("string")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("node"))
    seen = landed(seen, "addresses")

    as_url = F.concat(F.lit("://"), F.col("node"))
    linked = groups.select("node", "component", host_of(as_url).alias("host"), path_of(as_url).alias("path"))
    best = landed(ruled(seen.select("host", "path").unionByName(linked.select("host", "path")), rules), "ruled")

    decided = (
        linked.join(best, ["host", "path"])
        .groupBy("component")
        .agg(F.max((F.col("ruled") == ALLOW).cast("int")).alias("open"))
        .select("component", F.when(F.col("open") == 1, ALLOW).otherwise(BLOCK).alias("shared"))
    )
    aliases = groups.join(decided, "component", "left").select("node", F.col("component").alias("alias_group"), "shared")
    known = salted_join(seen, best, ["host", "path"], ["page_id"], "left")
    known = salted_join(known, aliases, ["node"], ["page_id"], "left", counted=seen)
    return known.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "shared", F.lit(ALLOW)).alias("verdict"),
        F.coalesce("alias_group", "node").alias("alias_group"),
    )
