from __future__ import annotations

import random
import re
from urllib.parse import urljoin

import duckdb
from pyspark.sql import functions as F

from mailfleet.llm.queries import ORACLES, URL_RULES
from mailfleet.llm.urls import Rule, judged, links_in
from tests.compare import oracle_rows, rows_of

PAGES = "page_id bigint, url string, html string, node string, rule int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], PAGES)


def canonical(url):
    return f"<html><LINK href='{url}' rel=\"canonical\"></html>"


def refresh(url):
    return f'<meta http-equiv="refresh" content="0; url={url}">'


ROWS = [
    (1, "http://a.example.net/es/x", None), (2, "https://b.example.org/2", canonical("http://a.example.net/es/x")),
    (3, "http://c.example.org/3", refresh("https://b.example.org/2#top")), (4, "http://d.example.org/4", ""),
    (5, "http://e.example.org/5", canonical("http://www.example.com/en/1")),
    (6, "HTTP://E.example.org/5#x", canonical("//a.example.net/es/x")),
    (7, "http://example.com/en/7", canonical("http://www.example.com/en/1")), (8, None, canonical("http://a.example.net/es/x")),
    (9, "no scheme", None), (10, "", ""), (11, "http://xnet/es/", None), (12, "http://NET/es/?q", None), (12, "http://net/es", None),
    (13, "http://f.example.org", canonical("/es/home")), (14, "http://f.example.org/es/home?x=1", None), (None, "http://q.net/fr/1#a?b", "<p>"),
    (15, "ftp://h.org?x://y/z", None), (16, "http://i.com\n/en/", None), (17, "http://j.example.org/" + "long" * 30_000, None),
    (18, "http://k.net/de/1", canonical("../es/x")), (19, "http://k.net/es/x", None), (20, "http://l.org/a/b", canonical("#top") + canonical("c") + refresh("../../../fr/y")),
    (21, "http://l.org/a/c", canonical("?p=2&amp;q=http://m.org/")), (22, "http://l.org/a/./c?p=2&q=http://m.org/", canonical("mailto:x@y.org")),
    (23, "http://n.net", canonical("es/")), (24, "http://o.net/x/..", refresh("http://o.net/fr/../fr/.")), (25, "http://o.net/", canonical("http://o.net/#a")),
]


def undotted(path):
    if "/." not in path:
        return path
    out, segments = [], path[1:].split("/")
    for x in segments + [""] * (segments[-1] in (".", "..")):
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    return "/" + "/".join(out)


def brute(rows, rules):
    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)([^#]*)", url or "")
        if not m:
            return "", "", None
        host = m[1].translate({c: c + 32 for c in range(65, 91)})
        return host, m[2], host + (undotted(m[2]) or "/") + m[3]

    def fit(host, path):
        good = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(good, key=lambda r: (len(r.text), r.verdict == "allow"), default=None)

    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    linked = set()
    for _, url, html in rows:
        for target in re.findall(r"href='([^']*)' rel|url=([^\"]*)\"", html or ""):
            to = (target[0] or target[1]).replace("&amp;", "&")
            to = urljoin(url, to) if "://" in (url or "") else to
            a, b = parts(url)[2], parts(to)[2]
            if a and b and a != b:
                linked |= {a, b}
                p, q = sorted((root(a), root(b)))
                least[q] = p
    decided = {}
    for x in linked:
        host, slash, rest = x.partition("/")
        r = fit(host, (slash + rest).partition("?")[0])
        if r:
            decided[root(x)] = min(decided.get(root(x), "block"), r.verdict)
    out = []
    for i, url, _ in rows:
        host, path, node = parts(url)
        own = fit(host, path)
        alias = root(node) if node in linked else None
        out.append((alias, host, i, path, own.text if own else None, own.verdict if own else decided.get(alias, "allow")))
    return sorted(out, key=repr)


def test_rules_and_aliases(spark):
    got = judged(pages_of(spark, ROWS), URL_RULES)
    assert rows_of(got) == brute(ROWS, URL_RULES)
    verdicts = {r.page_id: r.verdict for r in got.collect()}
    assert verdicts[4] == "allow" and verdicts[7] == "block" and verdicts[8] == "allow"
    assert verdicts[18] == "block"  # by a relative link
    assert verdicts[2] == verdicts[3] == "allow"  # the component also holds an explicit allow


def test_block_reaches_aliases(spark):
    rows = [ROWS[0], ROWS[1], ROWS[2]]
    assert {r.verdict for r in judged(pages_of(spark, rows), URL_RULES).collect()} == {"block"}


def test_oracle_and_brute_force_on_random_links(spark):
    rng = random.Random(8)
    urls = [f"http://{h}/{p}/{i}" for i, (h, p) in enumerate(
        (rng.choice(["a.org", "b.net", "www.example.com", "example.com", "c.d.org"]), rng.choice(["en", "es", "fr", "de"])) for _ in range(80))]
    relative = [f"{up}{p}/{i}" for i, (up, p) in enumerate((rng.choice(["../", "./../", "/x/../", "../../"]), rng.choice(["en", "es", "fr"])) for _ in range(80))]
    relative += ["?q=1", "#x", "sub/./y", "..", ".", "mailto:a@b.c"]

    def html():
        return "".join(rng.choice([canonical, refresh])(rng.choice(urls if rng.random() < 0.4 else relative)) for _ in range(rng.randrange(3)))

    rows = [(i, u, html() if rng.random() < 0.7 else None) for i, u in enumerate(urls)]
    pages = pages_of(spark, rows)
    got = rows_of(judged(pages, URL_RULES))
    assert got == brute(rows, URL_RULES)
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    duck.executemany("insert into pages values (?, ?, ?)", rows)
    assert got == oracle_rows(duck, ORACLES["op8_url_filter"], ["alias_of", "host", "page_id", "path", "rule", "verdict"])


def test_given_redirects_and_empty_tables(spark):
    redirects = spark.createDataFrame([("http://z.org/", "http://y.net/fr/1"), (None, "x"), ("http://z.org/", None)], "source string, target string")
    rows = [(1, "http://z.org", None)]
    assert [r.verdict for r in judged(pages_of(spark, rows), URL_RULES, redirects).collect()] == ["block"]
    assert judged(pages_of(spark, []), URL_RULES).count() == 0 and links_in(pages_of(spark, [])).count() == 0
    assert judged(pages_of(spark, [(1, "http://q.z.org/", None), *rows]), [Rule("block", "z.org/")]).where(F.col("rule") == "z.org/").count() == 1
