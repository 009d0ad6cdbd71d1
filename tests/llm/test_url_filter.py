import re

import pytest
from pyspark.sql import functions as F

from screenspark.llm import url_filter

URLS = [
    None, "", "nothing here", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/EN/",
    "http://a.example.com/en/page", "http://www.example.com/en/page", "http://m.www.example.com/en/page", "http://notexample.com/en/1",
    "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/", "http://com/", "http://com", "http://x.com?q=/en/", "ftp://É.NET/fr/ü", "a://b://c/d",
    "https://clean.org/a/b", "https://cheap-pills.org/a", "https://h.org/" + "x/" * 20_000, "http://x.org/\n/en/", "http://x.com:80/en/",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def deciding(host, path):
    fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_every_kind_of_url(spark):
    rows = [(k, u, "h") for k, u in enumerate(URLS)] + [(3, URLS[4], None), (None, URLS[4], None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    found = url_filter.page_verdicts(df).collect()
    assert len(found) == len(rows)
    expected = sorted(((k, *plain(u), deciding(*plain(u))[0]) for k, u, _ in rows), key=repr)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in found), key=repr) == expected
    assert all(r.verdict == (deciding(r.host, r.path)[1] or r.verdict) and r.verdict in ("allow", "block") for r in found)
    assert url_filter.page_verdicts(df.limit(0)).count() == 0


def test_trees_learn_from_labels(spark):
    urls = [(f"http://site{k}.org/a/{k}", 0.0) for k in range(80)] + [(f"http://x-{k}-y-{k}.biz/?a=1&b={k}&c=3", 1.0) for k in range(40)]
    labelled = spark.createDataFrame(urls, "url string, label double")
    new = spark.createDataFrame([(1, "http://other.org/a/7"), (2, "http://z-9-w-8.biz/?a=5&b=6&c=7")], "page_id int, url string")
    found = {r.id: r for r in url_filter.judged(new, rules=(), labelled=labelled).collect()}
    assert found[1].verdict == "allow" and found[2].verdict == "block"
    one_kind = url_filter.judged(new, rules=(), labelled=labelled.where("label = 0")).collect()
    assert {r.verdict for r in one_kind} == {"allow"}


def test_numbers(spark):
    df = spark.createDataFrame([("http://a-b.c.org/x/y.html?p=1&q=2#f",)], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    r = url_filter.lexical(df.withColumns({"host": host, "path": path})).first()
    assert (r.length, r.depth, r.dots, r.hyphens, r.parameters, r.fragment) == (35, 2, 2, 1, 2, 1)
    assert r.digits == pytest.approx(2 / 35) and 3.5 < r.entropy < 5
