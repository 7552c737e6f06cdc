import re

import pytest

from quillspark.llm.url_filter import RULES, filter_urls

SCHEMA = "page_id long, url string, host string, rule string, `range` int"
URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://Example.ORG/en/1x", "https://a.example.org/es/", "https://a.example.org/es", "http://notexample.org/es/1", "http://org", "http://org/", "http://b.org/q?x=/es/#y",
    "http://x.com/fr/a", "http://com/de/", "http://x.com/de/1#/fr/", "http://x.com/it/", "http://x.net/fr/", "ftp://user@h.example.org:80/en/1", "http://.org/", "http://org./", "http://É.example.org/en/1/\n", "http://a..org/z", "x://y://z/fr/", "http://EXAMPLE.org/en/2?/en/1",
]


def slow(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


@pytest.mark.parametrize("sampled", [20_000, 40])
def test_rules(spark, sampled):
    rows = [(i, u, "x", "y", 1) for i, u in enumerate(URLS * 4)] + [(None, URLS[6], "x", "y", 1), (3, URLS[6], "x", "y", 1), (3, URLS[6], "x", "y", 1)]
    rows += [(1000 + i, "http://hot.example.org/en/1", "", "", 0) for i in range(300)] + [(2000 + i, f"http://s{i % 50}.hot.com/{'fr' if i % 3 else 'de'}/{i}", "", "", 0) for i in range(300)]
    deep = [("block", "hot.com", "/fr/1"), ("allow", "s7.hot.com", "/"), ("block", "org", "/en/"), ("allow", "hot.example.org", "/en/12"), ("block", "net", "")]
    for rules in (RULES, RULES + deep):
        found = filter_urls(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*rules, (None, "org", "/"), ("block", None, "/"), ("block", "", "/")], "verdict string, host string, path string"), sampled_keys=sampled)
        got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect()), key=str)
        assert got == sorted(((r[0], *slow(r[1], rules)) for r in rows), key=str)


def test_empty(spark):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    assert filter_urls(spark.createDataFrame([], SCHEMA), rules).count() == 0
    none = filter_urls(spark.createDataFrame([(1, URLS[6], "", "", 0)], SCHEMA), rules.limit(0)).collect()
    assert [(r.rule, r.verdict) for r in none] == [(None, "allow")]
