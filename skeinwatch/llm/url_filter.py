"""URL filters with redirect equivalence, in DataFrame functions only.

Rules judge the URLs they fit. Redirects and canonical links join URLs into classes of aliases (connected components over
all edges); a URL without a rule of its own is blocked if its class holds a blocked URL and no explicitly allowed one.
A URL's own rule always stands.

Edges come from each page's `<link rel=canonical>` and `<meta http-equiv=refresh>`, and from a table of redirects
(src, dst) if there is one. A URL's node is its form without scheme, fragment, `www.`, `utm_` parameters and final slash,
its host in lower case: URLs that differ in these alone are always aliases, with and without links. Rules judge the URLs
themselves, never their nodes. Null URLs and URLs without `://` have an empty
host and path, fit no rule and are allowed. Repeated rows are judged each. Of rules of equal length an allow wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwatch.llm.common import ascii_lower, written
from skeinwatch.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct<rule, verdict> of the longest rule that fits; an allow goes before a block of the same length."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = out.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return out


def node_of(url: Column) -> Column:
    """The form in which aliases are compared; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(
        host != "",
        F.concat(host, F.regexp_replace(path_of(url), r"/$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))),
    )


def absolute(link: Column, base: Column) -> Column:
    """A link as an absolute URL, as seen from the page at base."""
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*(?:[^?#]*/)?", 0)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """src, dst URLs of the canonical links and immediate redirects that pages declare."""
    canonical = F.regexp_extract("html", r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract("html", r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    links = F.array(
        F.regexp_extract(canonical, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
        F.regexp_extract(refresh, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    found = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", F.explode(links).alias("link"))
    return found.where(F.col("link") != "").select(F.col("url").alias("src"), absolute(F.col("link"), F.col("url")).alias("dst"))


def _verdicts() -> list[Column]:
    return [F.max(F.coalesce(F.col("v") == v, F.lit(False))).alias(name) for v, name in (("allow", "allowed"), ("block", "blocked"))]


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and reason: rule, alias or default."""
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    seen = seen.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))

    def end(name: str) -> Column:
        own = F.col(name)
        return F.struct(node_of(own).alias("node"), rule_of(host_of(own), path_of(own), rules)["verdict"].alias("v"))

    ends = links.select(end("src").alias("a"), end("dst").alias("b")).where("a.node is not null and b.node is not null")
    ends = written(ends.distinct(), "url-links")
    edges = ends.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).where("src <> dst")
    classes = connected_components(edges)
    # Every URL of a class is judged as it stands: pages, and ends of links that needn't be pages here.
    ruled = seen.where("node is not null and __r is not null").select("node", F.col("__r")["verdict"].alias("v"))
    named = ends.select(F.inline(F.array("a", "b"))).where("v is not null").unionByName(ruled)
    own = named.groupBy("node").agg(*_verdicts())
    # A node without edges is a class of its own: URLs of one node are aliases whether or not something links to it.
    home = F.coalesce("component", "node").alias("component")
    told = own.join(classes, "node", "left").groupBy(home).agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    told = told.where("blocked and not allowed").select("component")
    spread = classes.join(told, "component").select("node").unionByName(told.withColumnRenamed("component", "node"))
    spread = spread.distinct().withColumn("__alias", F.lit(True))
    judged = seen.join(spread, "node", "left")
    rule, verdict = F.col("__r")["rule"], F.col("__r")["verdict"]
    return judged.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("__alias"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(rule.isNotNull(), F.lit("rule")).when(F.col("__alias"), F.lit("alias")).otherwise(F.lit("default")).alias("reason"),
    )
