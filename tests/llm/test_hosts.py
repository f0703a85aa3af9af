import pytest

from uwspark.llm import hosts as H

URLS = [
    ("http://a.com", "a.com", "", None), ("https://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/"),
    ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/"), ("http://blog.example.com/en/1", "blog.example.com", "/en/1", "example.com/en/"),
    ("http://example.com/EN/1", "example.com", "/EN/1", "com/"), ("http://x.example.net/es/1", "x.example.net", "/es/1", "net/es/"),
    ("http://net/fr/#", "net", "/fr/", "net/fr/"), ("http://x.org/en/", "x.org", "/en/", None), ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
    (None, "", "", None), ("", "", "", None), ("no scheme/at/all", "", "", None), ("a://b://c/d", "b:", "//c/d", None),
    ("http://h.com?x=/en/", "h.com", "", None), ("http://É.com/é", "É.com", "/é", "com/"), ("x://" + "h" * 5000 + ".com/" + "p" * 50000, "h" * 5000 + ".com", "/" + "p" * 50000, "com/"),
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u[0], "h") for i, u in enumerate(URLS)] + [(None, URLS[1][0], "h"), (1, URLS[1][0], "h")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "id bigint, bad int")
    got = H.judge_urls(pages, outcomes, H.RULES).collect()
    assert len(got) == len(rows)
    verdicts = {rule: v for v, rule in H.RULES}
    for r in got:
        _, host, path, rule = URLS[1 if r.page_id is None else r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule), r.page_id
        assert r.verdict == verdicts.get(rule, r.verdict) and r.verdict in ("allow", "block")
    assert H.judge_urls(pages.limit(0), outcomes, H.RULES).count() == 0
    assert H.judge_urls(pages, outcomes.limit(0), []).count() == len(rows)


def test_shrinkage(spark):
    """A bad host with much evidence is blocked; little evidence bounds less; a silent host follows its domain."""
    rows, bad = [], []
    for i in range(3000):
        rows.append((i, f"http://h{i % 60}.good{i % 20}.org/x"))
        bad.append((i, int(i % 50 == 0)))
    for i in range(3000, 3300):
        rows.append((i, f"http://spam{i % 3}.evil.org/x"))
        bad.append((i, 1))
    rows += [(4000, "http://new.evil.org/"), (4001, "http://one.fresh.org/"), (4002, "http://other.net/")]
    bad.append((4001, 1))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.page_id: r for r in H.judge_urls(pages, spark.createDataFrame(bad, "id bigint, bad int"), []).collect()}
    assert got[3000].verdict == "block" and got[5].verdict == "allow"
    assert got[3000].host_bound > got[4001].host_bound > got[5].host_bound
    assert got[4000].host_rate > 0.5 > got[5].host_rate and got[3000].host_rate > got[4001].host_rate
    assert all(0 <= r.host_bound <= r.host_rate <= 1 for r in got.values())


@pytest.mark.parametrize("host,domain,suffix", [("a.b.co.uk", "b.co.uk", "co.uk"), ("a.b.com", "b.com", "com"), ("com", "com", "com"), ("", "", ""), ("u@a.b.com:80", "b.com", "com")])
def test_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    r = spark.range(1).select(H.domain(F.lit(host)), H.suffix(F.lit(host))).first()
    assert tuple(r) == (domain, suffix)
