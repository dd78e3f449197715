import pytest

from fieldsong.llm import url_rules

RULES = url_rules.RULES
URLS = [
    None, "", "nothing", "http://", "http://org", "http://org/", "https://a.b.ORG/x?y#z", "http://forg/", "http://example.org/es/", "http://example.org/en/1", "http://www.example.org/en/199/x", "http://example.org/en/2",
    "http://EXAMPLE.com/fr/1", "http://x.com/de/", "http://x.com/de", "http://x.com?/de/", "ftp://com/fr/#a://b", "x://y://org/", "http://a.com:80/fr/", "//x.com/fr/", "http://example.org/es/\nmore", "http://.com/fr/", "http://com./fr/",
]


def by_hand(url, rules=RULES):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([k for k in (tail.find(c) for c in "/?#") if k >= 0], default=len(tail))
    host, path = "".join(c.lower() if c.isascii() else c for c in tail[:cut]), tail[cut:].split("?")[0].split("#")[0]
    fits = [(-len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = min(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_against_brute_force(spark):
    rows = [(k, u, "kept", "x", 1) for k, u in enumerate(URLS)] + [(0, URLS[6], "kept", "x", 1)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Host string, judged_url int")
    got = url_rules.filter_pages(pages)
    assert sorted(got.columns) == sorted(["page_id", "url", "html", "judged_url", "host", "path", "rule", "verdict"])
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == by_hand(r.url), r.url


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://org/"), (2, None)], "page_id long, url string")
    assert {(r.rule, r.verdict) for r in url_rules.filter_pages(pages, rules=[]).collect()} == {(None, "allow")}
    assert url_rules.filter_pages(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_rules.filter_pages(pages, rules=[("block", "", "/")])


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://org/")], "page_id long, url string")
    plan = url_rules.filter_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
