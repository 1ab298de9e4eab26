import re

from tracewell.llm import url_filter


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    rules = [*url_filter.RULES, ("block", "b.net", "/es/keep/"), ("allow", "net", "/es/keep"), ("block", "localhost", ""), ("block", "a.b.c.d.e.net", "/"), ("allow", "com", "/")]
    urls = [None, "", "nothing", "http://", "https://Example.COM/en/x", "https://www.example.com/en/x#y", "http://wwwexample.com/en/", "http://x.net/es/keep/1", "http://b.net/es/keep/1", "http://c.b.net/es/keep?x", "http://b.net/es/kee", "http://net/fr/", "ftp://u@x.net:80/es/", "http://localhost", "x://a.b.c.d.e.net/?q", "http://example.com", "http://a.com/\n", "http://É.com/é", "http://..com/", "http://" + "a." * 3000 + "com/", "http://net/es/\U0010ffff\U0010ffff", "http://net/es/" + "\U0010ffff" * 9, "http://net/es/" + "x" * 50000, "http://net/es\U0010ffff"]
    urls += ["http://c.b.net/es/keep/hot"] * 40
    pages = spark.createDataFrame([(k if k else None, u, "x", "y") for k, u in enumerate(urls + urls[:6])], "page_id long, url string, host string, verdict string")
    pages = pages.selectExpr("*", "'a' as row", "'b' as share", "'c' as top", "'d' as at", "'e' as sweep", "'f' as depth", "'g' as is_url")
    got = sorted((tuple(r) for r in url_filter.filter_urls(pages, url_filter.rules_table(spark, rules)).collect()), key=str)
    want = sorted(((k if k else None, *brute(u, rules)) for k, u in enumerate(urls + urls[:6])), key=str)
    assert got == want
    many = [*rules, *(("block", f"h{k}.net", f"/p{k % 7}") for k in range(300)), *(("allow", f"b.h{k}.net", f"/p{k % 7}/q") for k in range(0, 300, 3))]
    urls = [f"http://{x}h{k}.net/p{j}{y}" for k in range(0, 300, 7) for x in ("", "b.", "a.b.") for j in (k % 7, 9) for y in ("", "/q", "/z")]
    got = sorted((tuple(r) for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rules_table(spark, many)).collect()), key=str)
    assert got == sorted(((k, *brute(u, many)) for k, u in enumerate(urls)), key=str)
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_table(spark, rules)).count() == 0


def test_no_python_in_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = url_filter.filter_urls(pages, url_filter.rules_table(spark, url_filter.RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
