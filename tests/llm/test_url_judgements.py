"""Host, path, rule and given verdict of every page against a plain loop."""

from parley.llm.url_rules import judge_urls

SF = "/root/testdata/sf0.001"
RULES = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    behind = rest[cut:]
    path = behind[: min([behind.find(c) for c in "?#" if c in behind], default=len(behind))]
    fits = [(h, p) for h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: len(r[0]) + len(r[1]), default=None)


def test_every_page_by_hand(spark):
    odd = ["HTTP://EXAMPLE.net/EN/x", "x://É.NET/", "a://b://c.net/", "://net/", "http://net", "http://a.org?x=/fr/", "http://a.org/fr/#/de/",
           "http://www.example.com/de/../x?y#z", "", None, "mailto:x@y.net", "http://example.net/en", "http://anet/", "s://org/fr/a?b://c"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    pages = pages.union(spark.createDataFrame([(10**6 + k, u) for k, u in enumerate(odd)], "page_id long, url string"))
    url = {r.page_id: r.url for r in pages.collect()}
    rows = judge_urls(pages).collect()
    assert len(rows) == len(url)
    for r in rows:
        host, path, rule = by_hand(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1]), url[r.page_id]
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == RULES[rule])
