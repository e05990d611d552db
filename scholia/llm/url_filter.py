"""URL filter with redirect equivalence, in built-in functions only.

A rule (host, path) fits its host and every subdomain where the url's path starts with the rule's; the longest
fitting rule decides. A url that no rule fits takes over from its aliases: redirects and canonical links join
urls into components, found by distributed connected components; an explicit allow anywhere in the component
comes before a block, a block before the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import components, stored

#: Fixed values: (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule; of equally long ones the first in binary order. Null where none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted((r for r, _ in rules), key=lambda r: (-len(r), r), reverse=True):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_key(url: Column) -> Column:
    """What two spellings of one address share: no scheme, fragment, default port, tracking parameters
    (utm_*, ref) or closing slash; null where there is no host."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(r"^(utm_[^=]*|ref)(=|$)")), "&")
    key = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host != "", key)


def resolved(target: Column, url: Column) -> Column:
    """The address that a link means on the page at url: with a scheme and // as it stands, else by url's scheme,
    host and path, without . and .. segments. Null for an empty one, another scheme's, or a url without a host."""
    rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    segments = F.split(F.when(target.startswith("/"), rest).otherwise(F.concat(folder, rest)), "/")
    last = F.element_at(segments, -1)
    path = F.array_join(F.aggregate(
        F.when(last.isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments), F.array().cast("array<string>"),
        lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(x)))), "/")
    out = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
    out = out.when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host_of(url) == ""), F.lit(None).cast("string"))
    out = out.when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), target))
    return out.otherwise(F.concat(origin, F.when(rest == "", path_of(url)).otherwise(path), tail))


def link_targets(html: Column, url: Column) -> Column:
    """Addresses that the page at url declares for itself: link rel=canonical and meta refresh. A base element is
    not read."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"))
    canonical = F.transform(links, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)", 1))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    refresh = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)", 1))
    both = F.transform(F.concat(canonical, refresh), lambda u: F.regexp_replace(u, "&amp;", "&"))
    return F.filter(F.transform(both, lambda u: resolved(u, url)), lambda u: u.isNotNull())


def judge(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", rules=RULES, redirects: DataFrame | None = None, default="allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, component): a row for each row of pages.

    redirects: further edges (source, target) between urls, such as a crawler's. Null urls, and urls without a
    host, have no aliases: a rule or the default judges them. Null html declares no links. Repeated rows are
    judged alike. component: the hash that names the page's component, null without a host.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    verdicts = dict(rules)
    judged = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(url_key(F.col("url"))).alias("key"),
                         url_key(F.col("url")).isNotNull().alias("has"), F.explode_outer(link_targets(F.col("html"), F.coalesce("url", F.lit("")))).alias("target"))
    declared = judged.filter("has").filter(url_key(F.col("target")).isNotNull()).select("key", F.xxhash64(url_key(F.col("target"))).alias("other"))
    if redirects is not None:
        given = redirects.select(url_key(F.col("source")).alias("s"), url_key(F.col("target")).alias("t")).dropna()
        declared = declared.union(given.select(F.xxhash64("s"), F.xxhash64("t")))
        targets = redirects.select(F.explode(F.array("source", "target")).alias("url"))
    # an alias that is no page of its own is judged by its own url too
    links = stored(declared.distinct(), "url-links")
    roots = components(links, "key", "other", "url-cc").withColumnRenamed("id", "key")
    roots = stored(roots, "url-roots")
    named = rows.select("url").union(rows.select(F.explode(link_targets(F.col("html"), F.coalesce("url", F.lit("")))).alias("url")))
    if redirects is not None:
        named = named.union(targets)
    keyed = named.select(F.xxhash64(url_key(F.col("url"))).alias("key"), url_key(F.col("url")).isNotNull().alias("has"),
                         rule_for(host_of(F.col("url")), path_of(F.col("url")), rules).alias("rule")).filter("has AND rule IS NOT NULL")
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items()])
    said = keyed.select("key", verdict.alias("v")).groupBy("key").agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"))
    by_root = said.join(roots, "key", "left").select(F.coalesce("root", "key").alias("component"), "allow", "block")
    by_root = by_root.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    base = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       F.when(url_key(F.col("url")).isNotNull(), F.xxhash64(url_key(F.col("url")))).alias("key"))
    base = base.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    out = base.join(roots, "key", "left").withColumn("component", F.coalesce("root", "key")).join(by_root, "component", "left")
    taken = F.when(F.col("allow"), F.lit("allow")).when(F.col("block"), F.lit("block")).otherwise(F.lit(default))
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, taken).alias("verdict"), "component")
