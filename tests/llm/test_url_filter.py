import random

from dialogprep.llm.queries import URL_RULES
from dialogprep.llm.url_filter import judge_urls
from tests.llm.helpers import AZ


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut].translate(AZ), rest[cut:]
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string, key string, stack int, at int")


def judged(spark, rows, rules, **kw):
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted((tuple(x) for x in judge_urls(table(spark, rows), r, **kw).collect()), key=repr)


def test_fixed_rules_and_hard_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.ORG/x", "http://org/", "http://org", "https://m.example.org/es/1?q=/es/", "x://example.org/en/12#a",
            "http://notexample.org/es/1", "http://a.com/fr/", "http://a.com/fr", "http://b.com/de/1", "http://a..com/de/", "http://com./de/", "http://a.org:80/x",
            "http://a.b.c.d.e.f.g.org/" + "p" * 20000, "http://x/?y://org/", "http://É.org/é"]
    rows = [(i if i % 5 else None, u, None, "z", "k", 1, 2) for i, u in enumerate(urls * 2)]
    got = judged(spark, rows, list(URL_RULES))
    assert got == sorted(((r[0], *brute(r[1], URL_RULES)) for r in rows), key=repr)


def test_random_nested_rules_over_many_ranges(spark):
    rnd = random.Random(3)
    labels, segs = ["a", "b", "ab", "org", "com"], ["", "a", "b", "ab", "abc"]
    host = lambda n: ".".join(rnd.choice(labels) for _ in range(n))
    path = lambda n: "/" + "/".join(rnd.choice(segs) for _ in range(n))
    rules = sorted({(host(rnd.randint(1, 3)), path(rnd.randint(0, 2))): rnd.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rows = [(i, f"http://{host(rnd.randint(1, 4))}{path(rnd.randint(0, 4))}", None, "", "", 0, 0) for i in range(600)]
    rows += [(10_000 + i, "http://a.b.org/ab/abc", None, "", "", 0, 0) for i in range(500)]  # one hot key
    got = judged(spark, rows, rules, rows_per_range=100)
    assert got == sorted(((r[0], *brute(r[1], rules)) for r in rows), key=repr)


def test_no_rules_and_no_pages(spark):
    assert judged(spark, [(1, "http://a.org/", None, "", "", 0, 0)], []) == [(1, "a.org", "/", None, "allow")]
    assert judged(spark, [], list(URL_RULES)) == []
