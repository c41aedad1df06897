import random
from collections import Counter

from pyspark.sql import functions as F

from pathloom.llm import url_filter
from pathloom.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        h, p = h.lower(), "/" + p
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = len(h) + len(p), len(h), verdict
            if best is None or key > best[0]:
                best = key, h + p, verdict
    return host, path, *(best[1:] if best else (None, default))


def test_against_every_rule(spark):
    rng = random.Random(7)
    hosts = ["org", "example.org", "a.example.org", "EXAMPLE.org", "notexample.org", "com", "x.com", "x.com:80", "u@x.com", "", ".org", "a..com", "org.", "münchen.com", "İ.org"]
    paths = ["", "/", "/fr/", "/fr", "/fr/a", "/de/x", "/es/1", "/en/1", "/en/12", "/en/2", "?q=/fr/", "#/fr/", "/fr/?x#y", "//fr/", "/é\n/"]
    urls = [f"{rng.choice(['http', 'https', 'x', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://org/", "http://org/"]
    urls += ["http://" + "a." * 60_000 + "org/" + "b" * 100_000, "http://example.org/es/" + "é" * 200_000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.com/de/"), (1, urls[1])]
    rules = URL_RULES + [("block", "X.com/fr/"), ("allow", "x.com/fr/"), ("block", "com/fr/a"), ("allow", "a.example.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("Host", F.lit("clash")).withColumn("verdict", F.lit(1)).withColumn("r_host", F.lit(2)).withColumn("extra", F.lit("kept"))
    out = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules))
    assert out.columns == ["page_id", "url", "r_host", "extra", "host", "path", "rule", "verdict"]
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got == Counter((i, *brute(u, rules)) for i, u in rows)


def test_columns_named_like_inner_ones_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "u", "h", "p", "q", "b", "d")], "page_id long, url string, __url string, __head string, __h string, __p string, __best string, `a.b` string")
    (row,) = url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES)).collect()
    assert tuple(row) == (1, "http://a.org/x", "u", "h", "p", "q", "b", "d", "a.org", "/x", "org/", "allow")


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = url_filter.rule_table(spark, URL_RULES).limit(0)
    assert [tuple(r)[2:] for r in url_filter.filter_urls(pages, none).collect()] == [("a.org", "/", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, URL_RULES)).collect() == []


def test_no_python_on_executors(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
