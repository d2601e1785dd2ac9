import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecall.llm import url_filters as uf

URLS = [
    (1, "http://A.Example.ORG/es/1?q#f"), (2, "https://example.org/en/12"), (3, "https://example.org/en/2"), (4, "https://x.com/fr/1"), (5, "https://x.com/de/1"),
    (6, "https://bad.net/1"), (7, "https://bad.net/2"), (8, "https://good.net"), (9, None), (10, "no scheme.org/"), (11, ""), (12, "ftp://org"), (13, "://com/fr/"),
    (14, "http://notexample.org/es/9"), (15, "http://ÄB.co.uk/#x"), (15, "http://ÄB.co.uk/#x"), (None, "https://bad.net/3"), (16, "http://a.b.co.uk?x"), (17, "a://b://c"), (18, "http://com/de/" + "x" * 50000),
    (6, "http://u:p@shop.bad.net:8080/1"), (20, "http://shop.bad.net./2"), (21, "http://10.1.2.3:80/"), (22, "http://10.9.2.3"), (23, "http://[::1]:80/x"), (24, "http://u@x.gov.au"), (25, "http://co.uk"), (26, "http://..:7"), (27, "http://a.b.com.example"),
]


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in URLS], "page_id long, url string, host string")
    labels = spark.createDataFrame([(6, 0, 0), (7, 0, 1), (7, 1, 0), (8, 1, 0), (1, 1, 0), (2, 1, None), (3, None, None), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    return pages, labels


def test_rules_and_parts(tables):
    pages, labels = tables
    got = uf.judge_urls(pages, uf.label_outcomes(labels)).collect()
    assert len(got) == len(URLS)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (by[2].rule, by[2].verdict, by[3].rule, by[3].verdict) == ("example.org/en/1", "block", "org/", "allow")
    assert (by[4].rule, by[5].verdict, by[13].rule, by[14].rule) == ("com/fr/", "block", "com/fr/", "org/")
    assert all((by[i].host, by[i].path, by[i].rule) == ("", "", None) for i in (9, 10, 11))
    assert (by[12].host, by[12].path, by[12].rule) == ("org", "", None)
    assert (by[15].host, by[16].host, by[16].path) == ("Äb.co.uk", "a.b.co.uk", "")
    assert by[17].host == "b:" and len(by[18].path) == 50004


@pytest.mark.parametrize("empty", [False, True])
def test_equals_sql(spark, tables, empty):
    pages, labels = tables
    if empty:
        labels = labels.limit(0)
    con = duckdb.connect()
    con.register("p", pages.toPandas().astype({"page_id": "Int64"}))
    con.register("l", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    con.execute("create view pages as select * from p; create view labels as select * from l")
    want = con.execute(uf.oracle_sql()).fetchall()
    got = [tuple(r) for r in uf.judge_urls(pages, uf.label_outcomes(labels)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_levels_of_hosts(spark):
    cases = {
        "shop.example.co.uk:8080": ("example.co.uk", "co.uk"), "u@x.org": ("x.org", "org"), "u:p@a.x.org.": ("x.org", "org"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "10.1.2.3:80": ("10.1.2.3", "10.1.2.3"),
        "[::1]:80": ("[::1]", "[::1]"), "co.uk": ("co.uk", "co.uk"), "a.b.gov.au": ("b.gov.au", "gov.au"), "localhost": ("localhost", "localhost"), "": ("", ""), "x.co.example": ("co.example", "example"), "a.blog.pages.dev": ("pages.dev", "dev"),
    }
    hosts = spark.createDataFrame([(h,) for h in cases], "host string").withColumn("name", uf.name_of(F.col("host")))
    for listed in ((), ("pages.dev", "kawasaki.jp")):
        known = uf.Suffixes(listed=listed)
        got = {r.host: (r.d, r.s) for r in hosts.select("host", uf.domain_of(F.col("name"), known).alias("d"), uf.suffix_of(F.col("name"), known).alias("s")).collect()}
        assert got == cases | ({"a.blog.pages.dev": ("blog.pages.dev", "pages.dev")} if listed else {})


def test_bound_is_near_the_beta_quantile():
    x = (np.arange(200_000) + 0.5) / 200_000
    worst = 0.0
    for a in (5, 8, 20, 100, 900):
        for b in (5, 8, 20, 100, 900):
            density = (a - 1) * np.log(x) + (b - 1) * np.log(1 - x)
            density = np.exp(density - density.max())
            exact = x[np.searchsorted(np.cumsum(density) / density.sum(), 0.1)]
            mean = a / (a + b)
            worst = max(worst, abs(mean - uf.Reputation.z * np.sqrt(mean * (1 - mean) / (a + b + 1)) - exact))
    assert worst < 0.01


def test_host_is_shrunk_to_its_domain(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.{'bad' if i % 2 else 'fine'}.net/{i}") for i in range(800)] + [(1000, "http://new.bad.net"), (1001, "http://new.fine.net")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2 == 0 or i % 20 == 1) for i in range(800)], "page_id long, good boolean")
    got = {r.page_id: r.verdict for r in uf.judge_urls(pages, outcomes, rules=()).collect()}
    assert got[1000] == "block" and got[1001] == "allow" and got[3] == "block" and got[2] == "allow"


def test_no_pages(tables):
    pages, labels = tables
    assert uf.judge_urls(pages.limit(0), uf.label_outcomes(labels)).count() == 0
