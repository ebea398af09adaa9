from claimwright.llm import url_filter

RULES = url_filter.RULES


def judged(spark, urls, **options):
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    return {r.page_id: r for r in url_filter.judge(df, RULES, **options).collect()}


def test_parsing(spark):
    rows = judged(spark, ["http://A.Example.COM/en/7?x#y", "ftp://h", "no scheme", None, "x://y://z/p", "http://é.DE?q/a", "http://#f", "a://b/c/../d#?"])
    assert [(rows[k].host, rows[k].path) for k in range(8)] == [("a.example.com", "/en/7"), ("h", ""), ("", ""), ("", ""), ("y:", "//z/p"), ("é.de", ""), ("", ""), ("b", "/c/../d")]


def test_longest_rule_wins_on_host_and_subdomains(spark):
    urls = ["http://x.com/en/1", "http://example.com/en/70", "http://a.example.com/en/7", "http://notexample.com/en/7", "http://x.net/de/8", "http://www.example.net/de/8", "http://com/en/", "http://x.org/en/", "http://xorg/es/", "http://x.com/EN/"]
    rows = judged(spark, urls)
    assert [(rows[k].rule, rows[k].verdict) for k in range(10)] == [
        ("com/en/", "block"), ("example.com/en/7", "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"),
        ("example.net/de/8", "block"), ("com/en/", "block"), *[(None, "block" if rows[k].bound > 0.5 else "allow") for k in (7, 8, 9)],
    ]


def test_shrinkage_orders_hosts_by_evidence(spark):
    labelled = [("bad.spam.com", 1)] * 40 + [("new.spam.com", 1)] + [("other.spam.com", 1)] * 20 + [("good.org", 0)] * 40 + [("fine.org", 0)] * 5 + [("good.org", None)]
    rows = {r.host: r for r in url_filter.reputations(spark.createDataFrame(labelled, "host string, outcome int"))["host"].collect()}
    assert rows["bad.spam.com"].mean > rows["new.spam.com"].mean > 0.5 > rows["fine.org"].mean > rows["good.org"].mean
    assert rows["good.org"].n == 40 and rows["new.spam.com"].weight < rows["bad.spam.com"].weight


def test_unruled_pages_follow_their_host(spark):
    labelled = spark.createDataFrame([("bad.com", 1)] * 60 + [("ok.com", 0)] * 60, "host string, outcome int")
    rows = judged(spark, ["http://bad.com/x", "http://ok.com/x", "http://unknown.com/x", None], labelled=labelled)
    assert [rows[k].verdict for k in range(4)] == ["block", "allow", "allow", "allow"]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None)], "page_id long, url string")
    assert url_filter.judge(df, RULES).count() == 3 and url_filter.judge(df.limit(0), RULES).count() == 0


def test_hosts_without_labelled_pages_follow_their_domain_then_suffix(spark):
    labelled = spark.createDataFrame([(f"h{k}.bad.com", 1) for k in range(80)] + [(f"www.site{k}.biz", 1) for k in range(80)] + [(f"a{k}.co.uk", k % 2) for k in range(80)], "host string, outcome int")
    rows = judged(spark, ["http://new.bad.com/x", "http://never.biz/x", "http://other.com/x", "http://b.a1.co.uk/x", "http://zz.zz/x"], labelled=labelled)
    assert [rows[k].verdict for k in range(5)][:2] == ["block", "block"] and rows[0].bound > rows[2].bound and 0.5 < rows[3].mean < 1
    # a1.co.uk is a domain of its own, not all of co.uk
    assert {r.domain for r in spark.sql("SELECT 'b.a1.co.uk' AS host").select(url_filter.domain_of().alias("domain")).collect()} == {"a1.co.uk"}
    assert rows[4].mean is not None and judged(spark, ["http://new.bad.com/x"], labelled=labelled.limit(0))[0].verdict == "allow"
