"""URL rules that follow redirects and canonical links, in DataFrame operations only.

A page is judged by the longest rule that fits its own url. Pages without a rule take the decision of their
aliases: urls that redirects and canonical links connect form components, found by distributed joins, and an
explicit allow anywhere in a component takes precedence over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.components import components
from clickloom.session import staged

# (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
LINK_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
REFRESH_URL = r"(?is)\bcontent\s*=\s*[\"'][^\"'>]*?\burl\s*=\s*([^\s\"'>;]+)"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, group), F.lit(""))


def host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash, A-Z lower-cased; else empty."""
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to a question mark or hash; else empty."""
    return _part(url, 2)


def address(url: Column) -> Column:
    """Host, path and query, which tell urls apart; null for a null text or one without a host."""
    name = host(url)
    return F.when(name != "", F.concat(name, _part(url, 2), _part(url, 3)))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(length, allows, rule) of the longest rule that fits, null if none does; an allow wins a tie.

    A rule fits its host and all hosts below it, if the path starts with the rule's. ``rules`` is a list
    that the driver holds; a page looks its own few host suffixes up in it.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, name, start in rules:
        by_host.setdefault(name, []).append((verdict, start))
    if not by_host:
        return F.lit(None).cast("struct<length: int, allows: boolean, rule: string>")
    entries = []
    for name, own in by_host.items():
        listed = [F.struct(F.lit(start).alias("path"), F.lit(verdict == "allow").alias("allows"), F.lit(name + start).alias("rule")) for verdict, start in own]
        entries += [F.lit(name), F.array(*listed)]
    table = F.create_map(*entries)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(table[s], F.array().cast("array<struct<path: string, allows: boolean, rule: string>>")))), lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(known, lambda r: F.struct(F.length(r["rule"]).alias("length"), r["allows"].alias("allows"), r["rule"].alias("rule"))))


def _resolved(href: Column, host: Column, path: Column) -> Column:
    """The address that a link on a page leads to."""
    plain = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_replace(path, "[^/]*$", "")
    full = (
        F.when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), plain)
        .when(F.startswith(plain, F.lit("//")), F.concat(F.lit("http:"), plain))
        .when(F.startswith(plain, F.lit("/")), F.concat(F.lit("http://"), host, plain))
        .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", "/").otherwise(folder), plain))
    )
    return F.when((plain != "") & ~F.startswith(plain, F.lit("#")), address(full))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses of pages and of the canonical urls and refresh redirects that their html names."""
    tags = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK_TAGS), F.lit(0))).alias("tag"))
    href = F.concat(*(F.regexp_extract("tag", HREF, i) for i in (1, 2, 3)))
    target = F.when(F.col("tag").rlike(CANONICAL), href).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", REFRESH_URL, 1))
    links = tags.select(address(F.col("url")).alias("a"), _resolved(target, host(F.col("url")), path(F.col("url"))).alias("b"))
    return links.where("a is not null and b is not null and a <> b")


def judge(
    pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """A row per page: page_id, host, path, rule and verdict (allow or block).

    The verdict is that of the page's own rule. Without one it is allow if an alias of the page has an allow
    rule, else block if an alias has a block rule, else allow. Aliases are connected by canonical links, by
    refresh redirects and by ``redirects`` (urls ``source`` and ``target``); they count whether or not there
    is a page for them. A null url, or one without ://, has an empty host and path, no rule and no aliases.
    Null or empty html names no links. Repeated rows give repeated rows; other columns aren't read.
    """
    known = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    known = known.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("node"))
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")))
    labels = components(links)
    nodes = labels.select("node", "root").unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
    urls = F.concat(F.lit("http://"), F.col("node"))
    ruled = nodes.select("node", "root", fitting_rule(host(urls), path(urls), rules).alias("fit"))
    decided = staged(ruled.where("fit is not null").groupBy("root").agg(F.max("fit.allows").alias("decision")), "decided")
    aliases = staged(nodes.join(decided, "root").select("node", "decision"), "aliases")
    judged = known.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).join(aliases, "node", "left")
    allows = F.coalesce(F.col("fit.allows"), F.col("decision"), F.lit(True))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.when(allows, "allow").otherwise("block").alias("verdict"))
