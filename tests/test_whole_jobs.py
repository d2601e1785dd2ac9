"""Queries that must read every row of their tables, and clustering against brute force."""

import random
from collections import Counter

import pytest

from rolecall import lexicons as lx
from rolecall.operators import lifecycle as lc
from rolecall.plans.all import QUERIES
from rolecall.plans.fixtures import Tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["c11_field_relation", "c12_best_relation"])
def test_every_posting_with_fields_gets_a_relation(spark, name):
    t = Tables(spark, DATA)
    asked = t.requirements.where("field_list <> ''").join(t.postings.selectExpr("id as job_id"), "job_id")
    got = QUERIES[name](spark, DATA)
    assert {r.job_id for r in got.select("job_id").collect()} == {r.job_id for r in asked.select("job_id").collect()}
    assert {r.user_id for r in got.select("user_id").distinct().collect()} == {r.user_id for r in t.postings.select("user_id").distinct().collect()}


def test_every_posting_is_asked_whether_it_is_tracked(spark):
    got = {int(r.id) % 9 for r in QUERIES["c9_already_tracked"](spark, DATA).collect()}
    assert got == set(range(9))


def test_already_tracked_equals_brute_force(spark):
    titles = ["Process Engineer", "Engineer, Process", "the process engineer", "Data Analyst", "Senior Process Safety Design Engineer", "Senior Process Safety Design Engineer II"]
    rows = [(str(i), f"c{i % 3}", f"R-{i % 7}" if i % 4 == 0 else None, titles[i * 7 % 6], ["Pune", "", "Pune, India", "Mumbai"][i * 5 % 4], i % 2 == 0, i * 11 % 60) for i in range(60)]
    jobs = spark.createDataFrame(rows, "id string, company_id string, external_job_id string, title string, location string, is_official boolean, n int").selectExpr("* except (n)", "if(n % 13 = 0, null, date_add(date'1998-01-01', n)) as posted_at")

    def words(title):
        return {w for w in title.lower().replace(",", " ").split() if w != "the"}

    def clash(x, y):
        if x[0] == y[0] or x[1] != y[1]:
            return False
        place = [r[4].lower().replace(", india", "") for r in (x, y)]
        name = [" ".join(r[3].lower().replace(",", " ").split()) for r in (x, y)]
        if (x[2] is not None and x[2] == y[2]) or (name[0] == name[1] and place[0] == place[1] != ""):
            return True
        day = [None if r[6] % 13 == 0 else r[6] for r in (x, y)]
        alike = len(words(x[3]) & words(y[3])) / len(words(x[3]) | words(y[3]))
        return place[0] == place[1] != "" and (x[5] or y[5]) and (None in day or abs(day[0] - day[1]) <= 21) and alike >= 0.82

    want = {x[0] for x in rows if not any(clash(x, y) for y in rows)}
    assert 0 < len(want) < 60
    assert {r.id for r in lc.already_tracked(jobs, jobs).select("id").collect()} == want


LONG = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
TITLES = ["Graduate Process Engineer", "Process Engineer, Graduate", "The Graduate Process Engineer (Role)", "Process Engineer", "Data Analyst", "analyst data", "The Job", "of the job", "", LONG, f"{LONG} kilo", f"{LONG} kilo lima", " ".join(LONG.split()[:9]), LONG.replace("alpha", "zulu")]
ROW = "page_id string, url string, title string, location string, description string, method string, external_job_id string, posted_at string, closing_at string"


def clusters_by_brute_force(rows):
    def words(title):
        return {w for w in "".join(c if c.isalnum() else " " for c in title.lower()).split() if len(w) > 1 and w not in lx.STOP_WORDS}

    def clash(x, y):
        a, b = words(x[2]), words(y[2])
        return x[0] == y[0] and (x[1] == y[1] or (x[3] == y[3] and len(a & b) / max(len(a | b), 1) > 0.9))

    root = [r[1] for r in rows]
    pairs = [(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if clash(x, y)]
    while True:
        before = list(root)
        for i, j in pairs:
            root[i] = min(root[i], root[j])
        if root == before:
            return Counter((r[0], root[i]) for i, r in enumerate(rows))


def merged(spark, rows):
    return {(r.page_id, r.root): r.merged for r in lc.merge_extracted(spark.createDataFrame(rows, ROW)).collect()}


def extracted(page, url, title, location="Pune"):
    return (page, url, title, location, "d", "JSON_LD", None, None, None)


def test_merge_follows_reordered_titles_and_chains(spark):
    same = [extracted("p", "u1", TITLES[0]), extracted("p", "u2", TITLES[1]), extracted("p", "u3", TITLES[2])]
    assert merged(spark, same) == {("p", "u1"): 3}
    chain = [extracted("p", "a", "Data Analyst"), extracted("p", "b", "Data Analyst"), extracted("p", "b", "Process Engineer"), extracted("p", "c", "Process Engineer")]
    assert merged(spark, chain) == {("p", "a"): 4}
    path = [extracted("q", f"u{i:02d}", f"title number{i + d}") for i in range(40) for d in (0, 1)]
    assert merged(spark, path) == {("q", "u00"): 80}
    apart = [extracted("p", "u1", "Data Analyst"), extracted("p", "u2", "Data Analyst", "Mumbai"), extracted("q", "u1", "Data Analyst"), extracted("p", "u3", "The Job"), extracted("p", "u4", "The Job")]
    assert merged(spark, apart) == {("p", "u1"): 1, ("p", "u2"): 1, ("q", "u1"): 1, ("p", "u3"): 1, ("p", "u4"): 1}


def test_merge_clusters_equal_brute_force(spark):
    r = random.Random(7)
    rows = [extracted(f"p{r.randrange(40)}", f"u{r.randrange(30):02d}", r.choice(TITLES), r.choice(["Pune", "Mumbai", "Delhi"])) for _ in range(400)]
    assert merged(spark, rows) == clusters_by_brute_force(rows)


def test_links_stay_linear_in_a_busy_place(spark):
    # two variants of a title, 20,000 postings each, at one company and place on forty days
    days = 40
    jobs = spark.range(40_000).selectExpr(
        "lpad(cast(id as string), 6, '0') as id", "'c' as company_id", "cast(null as string) as external_job_id",
        "if(id % 2 = 0, 'Senior Process Safety Design Engineer Plant', 'Senior Process Safety Design Engineer Plant Lead') as title", "'Pune' as location", "id % 3 = 0 as is_official", f"date_add(date'1998-01-01', cast(id % {days} as int)) as posted_at",
    )
    links = lc.duplicate_links(jobs).groupBy("tier").count().collect()
    count = {r.tier: r["count"] for r in links}
    assert count[2] == 40_000 - 2 and 0 < count[3] <= 4 * days * days
    assert lc.already_tracked(jobs, jobs).count() == 0


def test_tier_three_links_every_pair_through_its_groups(spark):
    rnd = random.Random(9)
    titles = ["senior process safety design engineer", "senior process safety design engineer ii", "process safety design engineer senior (lead)", "data analyst"]
    rows = [(f"{i:03d}", f"c{i % 2}", None, rnd.choice(titles), "Pune", rnd.random() < 0.5, rnd.choice([None, *range(0, 60, 5)])) for i in range(120)]
    jobs = spark.createDataFrame(rows, "id string, company_id string, external_job_id string, title string, location string, is_official boolean, n int").selectExpr("* except (n)", "date_add(date'1998-01-01', n) as posted_at")
    group = {r[0]: (r[1], r[3], r[5], r[6]) for r in rows}
    head = {}
    for r in rows:
        head.setdefault(group[r[0]], r[0])
    linked = {(r.a, r.b) for r in lc.duplicate_links(jobs).where("tier = 3").collect()}
    words = lambda t: set(t.replace("(", " ").replace(")", " ").split())
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] == y[1] and x[3] != y[3]:
                alike = len(words(x[3]) & words(y[3])) / len(words(x[3]) | words(y[3])) >= 0.82
                near = x[6] is None or y[6] is None or abs(x[6] - y[6]) <= 21
                pair = tuple(sorted((head[group[x[0]]], head[group[y[0]]])))
                assert (pair in linked) == (alike and near and (x[5] or y[5]))


def test_merge_stars_need_no_rounds(spark, monkeypatch):
    made, plain = {}, lc.written

    def noted(df, name):
        out = plain(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lc, "written", noted)
    rows = [extracted(f"p{i % 4}", f"u{i:03d}", ("Data Analyst", "Process Engineer", "DATA analyst", "")[i % 7 % 4]) for i in range(120)]
    assert merged(spark, rows) == clusters_by_brute_force(rows)
    assert not made.get("clash-edges") and not made.get("clash-labels") and made["clash-urls"] < 120
    # of rows that tie in all that orders them, one is taken whole
    ties = [("p", "u", "Analyst", "Pune", "ab", "JSON_LD", None, None, None), ("p", "u", "Analyst", "Delhi", "ba", "JSON_LD", None, None, None)]
    (one,) = lc.merge_extracted(spark.createDataFrame(ties, ROW)).collect()
    assert (one.location, one.description) in {("Pune", "ab"), ("Delhi", "ba")}
