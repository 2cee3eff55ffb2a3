"""URL rules with decisions that spread over redirect and canonical-link aliases.

A page's own rule comes first: the longest one whose host is the page's host
or a parent of it and whose path starts the page's path. Pages without a rule
take their alias class's decision. Alias classes are the connected components
of the graph that joins a page's url to its canonical link, to the target of
its meta refresh, and to whatever a crawl log of redirects names. In a class,
an explicit allow outweighs any block; else one blocked alias blocks the class;
else the page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bipartrix.llm.common import text_or_empty
from bipartrix.llm.components import connected_components

#: (host, path, verdict)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are joined by host suffix instead of standing in the expression.
INLINE_RULES = 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.regexp_extract(text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(text_or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def inline_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def joined_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for long rule tables (host, path, verdict): an equi-join on the suffixes of each distinct host and path."""
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sites = pages.select("host", "path").distinct().withColumn("_s", F.explode(suffix))
    r = rules.select(F.col("host").alias("_s"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    fit = sites.join(r, "_s").where(F.col("path").startswith(F.col("_p")))
    name = F.concat("_s", "_p")
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length(name), F.col("_v") == "allow", name.alias("rule"), F.col("_v").alias("verdict"))).alias("_b"))
    return pages.join(best, ["host", "path"], "left").withColumn("own", F.when(F.col("_b").isNotNull(), F.struct("_b.rule", "_b.verdict"))).drop("_b")


def node_key(url: Column) -> Column:
    """The url as a node of the alias graph: without fragment, A-Z of scheme and host lower-cased as in rules."""
    url = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substring(url, F.length(head) + 1, F.length(url)))


def unescaped(value: Column) -> Column:
    """An attribute's value with its numeric character references and those of markup decoded, each once."""
    token = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);"

    def char(t: Column) -> Column:
        number = F.when(t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(t, "^&#([0-9]+)", 1)).try_cast("int")
        real = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number < 0x110000))
        out = F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(t.startswith("&#"), t)
        for name, c in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            out = out.when(t == f"&{name};", c)
        return out

    parts = F.zip_with(F.split(value, token), F.regexp_extract_all(value, F.lit(token), F.lit(0)), lambda p, t: F.concat(p, F.when(t.isNull(), "").otherwise(char(t))))
    return F.when(value.contains("&"), F.array_join(parts, "")).otherwise(value)


def without_dots(path: Column) -> Column:
    """A path from ``/`` on without ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    parts = F.split(F.concat(path, F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")), "/")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolved(links: DataFrame) -> DataFrame:
    """(u, v) of (u, _l): each link resolved against the page's url u as RFC 3986 (5.2) says, as a node.

    Links that are empty or name a scheme without a host are left out. Steps are
    columns of their own, for an expression that repeats them would grow without bound.
    """
    d = links.withColumn("_l", unescaped(F.col("_l"))).withColumn("_l", F.regexp_replace(F.trim("_l"), "(?s)#.*$", ""))
    d = d.withColumn("_o", F.regexp_extract("u", r"^([^:/?#]+://[^/?#]*)", 1)).withColumn("_p", F.regexp_extract("u", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))
    link, origin = F.col("_l"), F.col("_o")
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(F.regexp_extract("u", r"^([^:/?#]+)://", 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, "_p", link))
        .otherwise(F.concat(origin, F.when(F.col("_p") == "", "/").otherwise(F.regexp_extract("_p", "(?s)^(.*/)", 1)), link))
    )
    d = d.where((link != "") & (origin != "")).select("u", whole.alias("_w")).where("_w IS NOT NULL")
    d = d.withColumn("_h", F.regexp_extract("_w", r"^([^:/?#]+://[^/?#]*)", 1)).withColumn("_p", F.regexp_extract("_w", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))
    rest = F.substring(F.col("_w"), F.length("_h") + F.length("_p") + 1, F.length("_w"))
    return d.select("u", F.concat(F.translate("_h", UPPER, LOWER), without_dots(F.col("_p")), rest).alias("v"))


def alias_links(pages: DataFrame) -> DataFrame:
    """(u, v): edges from the pages' html: ``<link rel=canonical href>`` and ``<meta http-equiv=refresh>``."""
    html, url = text_or_empty("html"), node_key(text_or_empty("url"))
    pick = lambda tags, want, value: F.transform(F.filter(tags, lambda t: t.rlike(want)), lambda t: F.regexp_extract(t, value, 1))
    links = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    metas = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    canonical = pick(links, r"(?i)\brel\s*=\s*[\"']?canonical\b", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = pick(metas, r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    may = F.lower(html).rlike("canonical|refresh")
    found = pages.where(may).select(url.alias("u"), F.explode(F.concat(canonical, refresh)).alias("_l"))
    return resolved(found.where("u <> ''"))


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, alias_class.

    redirects: optional (source, target) urls of a crawl log. Null urls have
    empty host and path, fit no rule and have no alias. Repeated pages get
    equal rows; other columns of ``pages`` are ignored. ``alias_class`` is a
    url that stands for the class, null for a page without alias.
    """
    base = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        base = base.withColumn("own", inline_rule(F.col("host"), F.col("path"), rules))
    else:
        table = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
        base = joined_rule(base, table)
    edges = alias_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_key(F.col("source")).alias("u"), node_key(F.col("target")).alias("v")))
    classes = connected_components(edges)
    base = base.withColumn("_u", node_key(F.col("url")))
    members = base.join(classes.select(F.col("node").alias("_u"), "root"), "_u", "left")
    # A class's decision also counts aliases that were never crawled: they are judged by their own url.
    urls = classes.select(F.col("node"), "root", url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path"))
    urls = urls.withColumn("own", inline_rule(F.col("host"), F.col("path"), rules)) if isinstance(rules, list) and len(rules) <= INLINE_RULES else joined_rule(urls, table)
    decided = urls.groupBy("root").agg(F.bool_or(F.col("own.verdict") == "allow").alias("_allow"), F.bool_or(F.col("own.verdict") == "block").alias("_block"))
    out = members.join(decided, "root", "left")
    spread = F.when(F.col("_allow"), "allow").when(F.col("_block"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), spread).alias("verdict"), F.col("root").alias("alias_class"))
