import re
from itertools import combinations

import pytest

from pagewright.llm import url_rules
from tests.llm.conftest import SMALL


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in url_rules.filter_pages(pages, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        host, path = plain_parts(r.url)
        rule, verdict = plain_rule(host, path)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule)
        assert got[r.page_id].verdict in ("allow", "block") if verdict is None else got[r.page_id].verdict == verdict


def test_mined_rules_match_all_combinations(spark):
    urls = [(f"http://{h}.example.info/{p}/{k}?{q}=1", h == "bad" and p == "ads" or q == "spam") for k in range(6) for h in ("bad", "good") for p in ("ads", "news") for q in ("spam", "page")]
    df = spark.createDataFrame(urls, "url string, blocked boolean")
    rules = url_rules.mine(df, 0.05, 0.9, 1)
    rows = [(set(t), b) for t, b in df.select(url_rules.url_tokens("url"), "blocked").collect()]
    want = {}
    for size in range(1, 10):
        for c in {frozenset(c) for t, _ in rows for c in combinations(sorted(t), size)}:
            n, bad = sum(c <= t for t, _ in rows), sum(c <= t and b for t, b in rows)
            if bad >= 0.05 * len(rows) and bad >= 0.9 * n:
                want[c] = bad / n
    got = {frozenset(r.tokens): r for r in rules.collect()}
    assert {k: r.confidence for k, r in got.items()} == pytest.approx(want)
    count = lambda x: sum(x in t for t, _ in rows)
    assert all(count(r.anchor) == min(map(count, r.tokens)) for r in got.values())
    judged = {r.url: r.verdict for r in url_rules.judge(df.selectExpr("url", "1 AS host", "2 AS verdict"), rules).selectExpr("url", "_verdict AS verdict").collect()}
    for (url, _), (tokens, _) in zip(urls, rows, strict=True):
        assert judged[url] == ("block" if any(c <= tokens for c in want) else "allow")


def test_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (2, "HTTP://A.EXAMPLE.NET/en/x?y#z"), (None, "http://net"), (3, "http://x.net/"), (4, "a://b.org/fr/\n/c"), (5, "http://É.com/de/"), (6, "http://example.com/de/" + "x" * 50_000), (7, "https://notexample.com/de/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS html", "1 AS host", "2 AS blocked")
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 1), (2, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.path): r for r in url_rules.filter_pages(pages, labels, 0.9, 0.9, 1).collect()}
    want = {(k, plain_parts(u)[1]): (plain_parts(u)[0], *plain_rule(*plain_parts(u))) for k, u in rows}
    assert {k: (r.host, r.rule) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k].verdict == v[2] for k, v in want.items() if v[2])
    assert got[None, ""].rule is None and got[7, "/de/"].rule is None
    assert url_rules.filter_pages(pages, labels.where("false")).count() == len(rows)
    assert url_rules.filter_pages(pages.where("false"), labels).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("https://www.cheap-pills.example.com/de/6652.html?a=1&b#top",), ("a://b",), ("none",), (None,)], "url string")
    got = [r[0] for r in df.select(url_rules.url_tokens("url")).collect()]
    assert got[0] == sorted(["scheme:https", "suffix:com", "suffix:example.com", "label:www", "label:cheap-pills", "part:cheap", "part:pills", "path:de", "path:#.html", "extension:html", "key:a", "key:b"])
    assert got[1:] == [["scheme:a", "suffix:b"], [], []]
