import duckdb

from quantmill.llm import url_reputation as u


def pages(spark):
    urls = ["https://A.Example.com/en/7?x=1", "http://example.com/en/8", "http://x.net/de/1", "http://example.net/de/8/a", "http://y.example.net/de/9", "ftp://z.org/es/#t", "no scheme", None, "http://", "://q.com", "http://example.com:80/en/1", "http://spam.biz/a", "http://spam.biz/b", "a://b://c/d", "http://h.com?x/en/"]
    rows = [(i, x, "k") for i, x in enumerate(urls)] + [(20 + i, f"http://spam.biz/{i}", "k") for i in range(40)] + [(3, "http://example.net/de/8/a", "k")]
    return spark.createDataFrame(rows, "page_id long, url string, host string")


def test_rules_and_reputation_equal_sql(spark):
    p = pages(spark)
    labels = spark.createDataFrame([(20 + i, 0, 1) for i in range(30)] + [(i, 1, 0) for i in range(10)] + [(None, 0, 0), (50, None, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = u.filter_urls(p, u.outcomes_of_labels(labels)).select("page_id", "host", "path", "rule", "verdict").toPandas()
    con = duckdb.connect()
    con.register("pages", p.toPandas())
    con.register("labels", labels.toPandas())
    expected = con.sql(u.SQL).df()
    key = lambda df: sorted(tuple(None if v != v else v for v in r) for r in df[["page_id", "host", "path", "rule", "verdict"]].astype(object).itertuples(index=False, name=None))
    text = lambda rows: sorted(map(str, rows))
    clean = lambda df: text(tuple(None if v is None or v != v else v for v in r) for r in df[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False, name=None))
    assert key and clean(got) == clean(expected)
    by = {r.page_id: r for r in got.itertuples()}
    assert (by[0].host, by[0].path, by[0].rule, by[0].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (by[1].rule, by[1].verdict) == ("com/en/", "block") and (by[3].rule, by[3].verdict) == ("example.net/de/8", "block") and by[4].verdict == "allow"
    assert (by[6].host, by[6].path, by[7].host) == ("", "", "") and by[11].verdict == "block" and by[13].host == "b:"


def test_empty(spark):
    p, none = pages(spark), spark.createDataFrame([], "page_id long, bad boolean")
    assert set(r.verdict for r in u.filter_urls(p, none).where("rule is null").collect()) == {"allow"}
    assert u.filter_urls(p.limit(0), none).count() == 0


def test_rules_are_joined_and_ties_are_settled(spark):
    p = spark.createDataFrame([(1, "http://a.b.com/x/" + "y" * 100_000), (2, "http://b.com/x"), (3, "http://c.com/"), (4, None)], "page_id long, url string")
    rules = [("allow", "b.com/x"), ("block", "b.com/x"), ("allow", "com/"), ("block", "a.b.com/x/yy")] + [("block", f"h{i}.org/") for i in range(1500)]
    got = {r.page_id: (r.rule, r.verdict) for r in u.filter_urls(p, spark.createDataFrame([], "page_id long, bad boolean"), rules).collect()}
    assert got == {1: ("a.b.com/x/yy", "block"), 2: ("b.com/x", "block"), 3: ("com/", "allow"), 4: (None, "allow")}


def test_suffixes_of_two_labels(spark):
    p = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["www.bbc.co.uk", "co.uk", "a.example.com", "localhost"])], "page_id long, url string")
    host, _ = u.split_url(p["url"])
    hosts = u.host_reputation(p.select("page_id", host.alias("host")), spark.createDataFrame([(0, True)], "page_id long, bad boolean"))
    assert {r.host for r in hosts.collect()} == {"www.bbc.co.uk", "co.uk", "a.example.com", "localhost"}
