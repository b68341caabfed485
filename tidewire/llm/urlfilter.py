"""URL filters with redirect equivalence.

A rule names a host (which covers its subdomains) and a path prefix; the longest that fits decides. Pages that redirect
to one another or name one another as canonical are aliases: connected components over these edges carry a block to
every alias that no rule of its own allows. An explicit allow always stands.

Null URL, or one without '://': host and path are empty and no rule fits. Repeated URLs are judged alike. Edges whose
end is null are left out. Null pages have no edges. Rules of equal length: the last listed counts. Columns other than the
id, the URL and the page are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.graph import connected_components



@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path): the path is everything from the host's end to the query or fragment."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct<text, verdict>, else null; one codegen expression, no join.

    Among rules of one text the last listed counts.
    """
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def normal_url(url: Column) -> Column:
    """Scheme, fragment, tracking parameters and a last slash don't make another page."""
    host, path = split_url(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")), "&")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def html_target(html: Column) -> Column:
    """The address that a page names as canonical, or else refreshes to; '' where there is none."""
    link = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    fresh = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh\b)[^>]*?url\s*=\s*[\"']?([^\"'\s>]+)", 1)
    # Most pages name none: one look for the words spares them the patterns.
    return F.when(html.rlike("(?i)canonical|refresh"), F.when(link != "", link).otherwise(fresh)).otherwise("")


def without_dots(path: Column) -> Column:
    """A path without its . and .. parts."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    last = F.element_at(F.split(path, "/"), -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve(base: Column, target: Column) -> Column:
    """The absolute address that a target names on a page (RFC 3986); null for other schemes than http and https, and where
    the page's own address has no scheme."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(base, r"^[^:/?#]+://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    own = F.regexp_extract(target, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    tail = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    head = F.regexp_extract(target, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    inside = F.when(head == "", path).when(head.startswith("/"), without_dots(head)).otherwise(without_dots(F.concat(folder, head)))
    joined = F.when(F.lower(own).isin("http", "https"), target).when(own != "", F.lit(None)).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).otherwise(F.concat(scheme, F.lit("://"), host, inside, tail))
    return F.when((own != "") | (scheme != ""), joined)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) over normal addresses, from canonical links and refreshes; relative targets are resolved."""
    out = pages.select(F.col(url).alias("u"), html_target(F.col(html)).alias("t")).filter("t <> ''")
    out = out.select("u", resolve(F.col("u"), F.col("t")).alias("t")).filter("t is not null")
    return out.select(normal_url(F.col("u")).alias("src"), normal_url(F.col("t")).alias("dst")).filter("src <> dst and src <> '' and dst <> ''").distinct()


def filter_urls(pages: DataFrame, edges: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, alias_block).

    edges: (src, dst) over normal_url() addresses. An alias class is blocked if a page in it, or an address that an edge
    names, is blocked by rule; then its pages are blocked too unless a rule allows them.
    """
    host, path = split_url(F.col(url))
    own = pages.select(F.col(id_column), host.alias("host"), path.alias("path"), normal_url(F.col(url)).alias("node")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    classes = connected_components(edges)
    # An address of an edge may have no page: it is judged as the address it is.
    named = classes.select("node", "component", F.concat(F.lit("x://"), "node").alias("address"))
    named_host, named_path = split_url(F.col("address"))
    named = named.withColumn("fit", rule_of(named_host, named_path, rules)).filter("fit.verdict = 'block'").select("component")
    paged = own.filter("fit.verdict = 'block'").select("node").distinct().join(classes, "node").select("component")
    blocked = named.unionByName(paged).distinct()
    aliases = classes.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("alias_block"))
    # Every page whose class has no block needs no row of the join: most nodes have no edge at all.
    out = own.join(aliases, "node", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("alias_block"), "block"), F.lit("allow"))
    return out.select(F.col(id_column), "host", "path", F.col("fit.text").alias("rule"), verdict.alias("verdict"), F.coalesce("alias_block", F.lit(False)).alias("alias_block"))
