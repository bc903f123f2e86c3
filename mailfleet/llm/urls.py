"""URL rules that reach aliases through redirects and canonical links.

A rule names a host and a path prefix and says allow or block; the longest one that fits a URL decides
about it. URLs that lead to one another (a page's own canonical link, a refresh to another address,
given redirects) are one resource: connected components of these edges carry a decision to the URLs
that no rule fits. An allow in a component goes before a block, and a URL's own rule before both; what
nothing decides is allowed.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.llm.graph import components


class Rule(NamedTuple):
    """``text`` is host and path, like ``example.com/en/``; the path starts at the first slash."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z as a-z; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments resolved; others stay as they are."""
    step = lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(
        x == ".", held).otherwise(F.concat(held, F.array(x)))
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    # What ends with a dot segment is a folder.
    segments = F.when(path.rlike(r"/\.{1,2}$"), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    left = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(left, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """What two spellings of an address share: host, path without dot segments, query; no scheme, no fragment."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(without_dots(path_of(url)))
    return F.when(url.contains("://"), F.concat(host_of(url), path, query))


def resolved(target: Column, base: Column) -> Column:
    """The address that a link's ``target`` names on the page ``base``; null for a place on that page."""
    site = F.concat(F.lit("http://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(base), target))
        .when(~target.startswith("#"), F.concat(site, F.when(folder == "", "/").otherwise(folder), target)))


def matching_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """``verdict, rule`` of the longest rule that fits, null without one; a rule set is a bounded list.

    A rule fits its host and all its subdomains where the path starts with the rule's. Of equally long
    rules an allow goes first.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.verdict).alias("verdict"), F.lit(rule.text).alias("rule"))).otherwise(found)
    return found


_ATTRIBUTE = r"""["']?\s*([^"'\s>]+)"""


def links_in(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: nodes of each page and of all canonical and refresh addresses its html names.

    Relative addresses are resolved against the page's own, and ``&amp;`` is read as ``&``.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))

    def named_by(tag: str, attribute: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(rf"(?is)({tag})"), F.lit(1))
        return F.transform(tags, lambda t: F.regexp_extract(t, rf"(?is)\b{attribute}\s*=\s*" + _ATTRIBUTE, 1))

    targets = F.concat(
        named_by(r"<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", "href"),
        named_by(r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", "url"))
    named = pages.select(F.col(url_col).alias("_from"), F.explode(targets).alias("_to")).where("_to <> ''")
    target = F.replace(F.col("_to"), F.lit("&amp;"), F.lit("&"))
    return named.select(node_of(F.col("_from")).alias("a"), node_of(resolved(target, F.col("_from"))).alias("b")).where(
        "a is not null and b is not null and a <> b")


def judged(
    pages: DataFrame, rules: Iterable[Rule], redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, alias_of`` for each row of ``pages``.

    ``redirects`` has further edges in its columns ``source`` and ``target`` (URLs). ``alias_of`` is the
    least node of a linked URL's component, else null. Null URLs and ones without ``://`` have an empty
    host and path, and no links. Ids pass unchanged; other columns are ignored, whatever their names.
    """
    rules = list(rules)
    edges = links_in(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(
            node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null"))
    groups = components(edges)
    # Every member of a component counts, also one that is only linked to.
    as_url = F.concat(F.lit("x://"), F.col("node"))
    member = groups.withColumn("_v", matching_rule(host_of(as_url), path_of(as_url), rules)["verdict"])
    decided = member.groupBy("component").agg(F.min("_v").alias("_inherited"))  # allow sorts before block
    inherited = groups.join(decided, "component").select(
        F.col("node").alias("_node"), F.col("component").alias("alias_of"), "_inherited")
    url = F.col(url_col)
    own = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.coalesce(node_of(url), F.concat(F.lit("no url "), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_at"))
    found = own.withColumn("_own", matching_rule(F.col("host"), F.col("path"), rules))
    return found.join(inherited, found["_at"] == inherited["_node"], "left").select(
        "page_id", "host", "path", F.col("_own.rule").alias("rule"),
        F.coalesce("_own.verdict", "_inherited", F.lit("allow")).alias("verdict"), "alias_of")
