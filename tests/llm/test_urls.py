from millrace.llm import urls as U

SCHEMA = "page_id long, url string, host string, rule int, digest string"


def judge(url, rules=U.RULES, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "://", "http:///path", "http://Example.ORG", "http://example.org/", "https://a.b.example.org/es/x", "http://example.org/en/1", "http://example.org/en/123?q=1", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/de", "http://com/de/", "http://com.net/de/", "http://x.com?/de/", "http://x.com#/de/", "ftp://user@x.com:80/de/", "http://x.com/DE/",
    "http://org/", "http://org", "http://..org/x", "http://a" + ".b" * 5000 + ".com/de/" + "p" * 50_000, "a://b://x.com/de/", "http://x.com/fr/\n",
]


def test_against_brute_force(spark):
    given = [(i, u, "h", 1, "d") for i, u in enumerate(URLS * 2)]
    found = {r.page_id: tuple(r)[1:] for r in U.judge_urls(spark.createDataFrame(given, SCHEMA), U.rules_table(spark)).collect()}
    assert found == {i: judge(u) for i, u, *_ in given}


def test_rules_in_general(spark):
    rules = [("block", "A.com", "/x"), ("allow", "a.com", "/x"), ("allow", "a.com", ""), ("block", "b.a.com", "/"), ("block", "", "/q")]
    low = [(v, h.lower(), p) for v, h, p in rules]
    given = [(1, "http://a.com/x"), (2, "http://c.a.com"), (3, "http://b.a.com/x"), (4, "http://z.net/"), (4, "http://z.net/"), (None, "http://a.com/y")]
    table = U.rules_table(spark, rules)
    found = U.judge_urls(spark.createDataFrame(given, "page_id long, url string"), table, "block").collect()
    assert sorted((r.page_id or 0, r.verdict) for r in found) == sorted((i or 0, judge(u, low, "block")[3]) for i, u in given)
    assert {r.verdict for r in U.judge_urls(spark.createDataFrame(given, "page_id long, url string"), table.limit(0)).collect()} == {"allow"}
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), table).count() == 0
