"""URL rules against plain string comparison."""

import random

from pyspark.sql import functions as F

from seasoncast.llm.url_filter import filter_urls


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = [
        (len(h + p), len(h), a, h + p)
        for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_equals_plain_comparison(spark):
    draw = random.Random(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "net", "B.A.com", "", "é.Net"]
    paths = ["", "/", "/x", "/x/", "/x/y.html", "/x/yz/w", "/q?/x/", "#/x/"]
    rules = [(h, p, draw.choice(["allow", "block"])) for h in ("com", "a.com", "b.a.com", "net") for p in ("", "/", "/x", "/x/y")]
    rules.append(("a.com", "/x", "block"))
    urls = [f"{s}{h}{p}" for s in ("http://", "s://t://", "") for h in hosts for p in paths]
    urls += [None, "", "http://", "http://a.com" + "/x" * 20000, urls[3], urls[3]]
    rows = [(i // 2 if i else None, u, "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id int, url string, host string")
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, action string")
    key = lambda rows: sorted(map(repr, rows))
    for salts in (True, False):
        own = table if salts else F.broadcast(table)
        got = filter_urls(pages, own, "page_id").collect()
        assert key(map(tuple, got)) == key((i, *plain(u, rules)) for i, u, _ in rows)


def test_no_rules_and_no_urls(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id int, url string")
    assert [tuple(r) for r in filter_urls(pages, rules, "page_id").collect()] == [
        (1, "a.b", "/c", None, "allow")
    ]
    assert filter_urls(pages.limit(0), rules, "page_id").count() == 0
