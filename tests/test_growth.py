"""Work that must not grow faster than its rows: timers, texts read once, arrays made once."""

import itertools

import pandas as pd
from pyspark.sql import functions as F

from rolecall.operators import requirements as rq
from rolecall.plans import sources
from rolecall.plans.fixtures import Tables
from rolecall.sources import pages, sites
from rolecall.streaming import ordered


class _State:
    def __init__(self, calls):
        self.value, self.calls = None, calls

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls["get"] += 1
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers, self.calls = set(), {"get": 0, "timers": 0}

    def getListState(self, name, schema):
        return _State(self.calls)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls["timers"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_key_has_one_timer_for_all_its_rows():
    fold = ordered.Settled("at long, seq long, year int", "year int", ["at", "seq", "year"], ordered._changed, lambda carried: None)
    handle, out = _Handle(), []
    fold.init(handle)
    # batches of rows whose times overlap; the watermark follows behind
    for batch in range(4):
        rows = pd.DataFrame({"at": [(batch * 500 + i * 7 % 1000) * 1_000_000 for i in range(1000)], "seq": range(batch * 1000, batch * 1000 + 1000), "year": [2020 + i % 2 for i in range(1000)]})
        list(fold.handleInputRows(("u",), iter([rows]), None))
        now = batch * 500_000
        for at in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(at)
            out += fold.handleExpiredTimer(("u",), _Watermark(now), None)
        assert len(handle.timers) == 1
    end = 10**9
    for at in sorted(handle.timers):
        handle.timers.discard(at)
        out += fold.handleExpiredTimer(("u",), _Watermark(end), None)
    every = sorted(((b * 500 + i * 7 % 1000) * 1_000_000, b * 1000 + i, 2020 + i % 2) for b in range(4) for i in range(1000))
    want = [(at, seq) for (_, _, was), (at, seq, year) in itertools.pairwise(every) if was != year]
    assert [tuple(map(int, r[1:])) for part in out for r in part.itertuples(index=False)] == want
    assert handle.calls["timers"] <= 10 and handle.calls["get"] <= 40


def test_escaped_type_is_found_and_arrays_are_made_once(spark):
    body = '<script type="application/ld+json">{"@type": "%s", "title": "a"}</script><script type="application/ld+json">{bad</script>'
    rows = [(1, "u", body % "JobPosting"), (2, "u", body % (chr(92) + "u004aobPosting")), (3, "u", body % "Person"), (4, "u", None)]
    nodes = pages.json_ld_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(r.page_id for r in nodes.select("page_id").collect()) == [1, 2]
    # a filter on the size of an array would be pushed below the steps that make it
    assert "size(_all" not in nodes._jdf.queryExecution().optimizedPlan().toString().replace("#", "")
    assert not any("Filter" in line and "transform(" in line for line in nodes._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_texts_are_read_once_for_all_postings_that_share_them(spark):
    said = "We need a B.Tech with 2-4 years. Python is required."
    rows = [(str(i), None if i == 6 else "Process Engineer", said, None, 1.0 if i % 2 else None, None, (None, " Pune ", "Delhi")[i % 3]) for i in range(7)]
    jobs = spark.createDataFrame(rows, "id string, title string, description string, education_requirement string, experience_min double, experience_max double, location string")
    made = rq.extract(jobs, F.lit("2026-06-01").cast("date"))
    assert "Aggregate" in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.requirements for r in made.collect()}
    assert len(got) == 7 and made.columns == [*jobs.columns, "requirements"]
    for i, r in ((int(k), r) for k, r in got.items()):
        assert (r.experience_min, r.experience_max) == ((1.0, None) if i % 2 else (2.0, 4.0))
        assert r.locations == ([], ["Pune"], ["Delhi"])[i % 3] and r.skills_required == ["PYTHON"] and r.degree_level == "BACHELOR"


def test_rows_of_one_file_go_to_all_cores(spark):
    assert Tables(spark, "/root/testdata/sf0.001").dealt_postings.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_texts_statements_are_split_once(spark):
    plan = spark.range(1).select(pages.partition_text(F.lit("x").cast("string")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_companies_and_listing_pages_go_to_all_cores(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    most = spark.sparkContext.defaultParallelism
    assert t.dealt_companies.rdd.getNumPartitions() >= most
    assert sources.results(t).rdd.getNumPartitions() >= most
    assert sources.listing_pages(t).rdd.getNumPartitions() >= most


def test_a_host_is_found_once_for_a_score(spark):
    rows = [("https://boards.greenhouse.io/a", "Careers"), ("https://x.org/about", None), (None, "Jobs")]
    urls = spark.createDataFrame(rows, "url string, title string")
    made = urls.select(sites.careers_score(F.col("url"), F.col("title"), F.lit("x.org")).alias("s"))
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == 1
    assert [r.s for r in made.collect()] == [0.65, 0.1, 0.3]
    assert [r.a for r in urls.select(sites.is_ats(sites.tx.url_host(F.col("url"))).alias("a")).collect()] == [True, False, None]


def test_extractors_read_each_page_once(spark):
    item = '<div itemscope ItemType="https://schema&#46;org/JobPosting"><b itemprop="title">Process Engineer</b></div>'
    link = '<ul><li><A\n\thref="/p/1">Process Engineer</A> Location: Pune</li></ul>'
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "title": "a"}</script>'
    rows = [(1, item + link), (2, link), (3, ld + link), (4, "<p>itemtype</p><abbr>a</abbr>"), (5, None), (None, link), (None, item)]
    df = spark.createDataFrame([(i, "https://x.org/", html) for i, html in rows], "page_id long, url string, html string")
    found = sources.all_raw(None, df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 2
    got = sorted((r.page_id or 0, r.method, r.authoritative) for r in found.collect())
    assert got == [(0, "HEURISTIC", False), (0, "MICRODATA", True), (1, "MICRODATA", True), (2, "HEURISTIC", False), (3, "JSON_LD", True)]
    # pages that can't hold any aren't parsed
    assert all("Filter" in make(df)._jdf.queryExecution().optimizedPlan().toString() for make in (pages.microdata, pages.anchors))
