"""Deep pages, pages by last key, and the two-level running maximum, against plain versions."""

import random

from pyspark.sql import functions as F

from rolecall.operators import lifecycle as lc
from rolecall.operators import listing, search_index


def test_deep_pages_read_their_ranges_only(spark):
    rnd = random.Random(2)
    rows = [(f"{i:05d}", rnd.choice([None, 1, 2, 3, 3, 3])) for i in range(3000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, n int")
    order = [F.desc_nulls_last("n"), F.asc("id")]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    pages = listing.SortedPages(df, order, ranges=12)
    assert pages.total == 3000 and len(pages.ranges) > 6
    for offset in (0, 1, 777, 1500, 2990, 3000, 9999):
        assert [r.id for r in pages.page(50, offset).collect()] == want[offset : offset + 50]
    largest = max(n for _, n in pages.ranges)
    assert largest < 3000 / 4
    got, last = [], None
    for _ in range(62):
        some = (listing.page(df, order, 50) if last is None else listing.page_after(df, [("n", False), ("id", True)], last)).collect()
        got += [r.id for r in some]
        if not some:
            break
        last = some[-1].asDict()
    assert got == want


def test_pages_of_an_empty_table(spark):
    pages = listing.SortedPages(spark.createDataFrame([], "id string"), [F.asc("id")])
    assert pages.total == 0 and pages.page(50, 0).count() == 0


def test_overlapping_runs_of_a_hot_key(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        key = ("u", "hot") if i % 2 else (rnd.choice(["u", None, "v"]), f"c{i % 7}")
        start = i * 1000 // 500 * 500
        rows.append((*key, f"r{i:04d}", start, None if i == 2001 else start + rnd.choice([0, 10, 400, 90_000 if i % 50 == 1 else 700])))
    df = spark.createDataFrame(rows, "user_id string, company_id string, run_id string, s long, e long")
    df = df.selectExpr("user_id", "company_id", "run_id", *[f"timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, {c}) as {n}" for c, n in (("s", "started_at"), ("e", "completed_at"))])
    busy, want = {}, set()
    for u, c, r, s, e in sorted(rows, key=lambda x: (x[3], x[2])):
        if busy.get((u, c), -1) > s:
            want.add(r)
        busy[u, c] = max(busy.get((u, c), -1), 1e18 if e is None else e)
    for block in ("hour", "day", "year"):
        assert {r.run_id for r in lc.overlapping_runs(df, block).collect()} == want
    assert 100 < len(want) < 2500
    # what a task sorts is a block: none has more than twice the mean, though one key has half of all rows
    sizes = [r["count"] for r in df.where("company_id = 'hot'").groupBy(F.date_trunc("day", "started_at")).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_indexed_search_equals_a_scan(spark):
    rnd = random.Random(6)
    words = ["Process", "R&D", "chem", "ChemE", "50%", "a_b", "Öl", "öl", "ab", "", "İstanbul", "x\\y"]
    rows = [(i, rnd.choice([None, " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))]), rnd.choice(words)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    index = search_index.TrigramIndex(df, "id", ["a", "b"], ranges=4)
    for part in ("chem", "CHEM", "r&d", "process chem", "ab", "", "%", "che_e", "pro%chem", "50%", "öl ab", "ÖL AB", "istanbul", "nowhere", "rocess%r&"):
        want = {r.id for r in df.where(listing.like(F.col("a"), part) | listing.like(F.col("b"), part)).collect()}
        assert {r.id for r in index.find(part).collect()} == want, part
    plan = index.find("process chem")._jdf.queryExecution().toString()
    assert "EqualTo(gram," in plan and search_index.grams_of("ab%c_") == []


def test_a_text_is_indexed_once_for_all_its_rows(spark):
    df = spark.createDataFrame([(i, f"Process {i % 3}", None if i % 2 else "R&D chem") for i in range(600)], "id int, a string, b string")
    index = search_index.TrigramIndex(df, "id", ["a", "b"], ranges=4)
    assert index.lines.count() == len({(t, t[i : i + 3]) for t in ("process 0", "process 1", "process 2", "r&d chem") for i in range(len(t) - 2)})
    # two texts of one hash are told apart by another seed
    clashing = search_index.TrigramIndex(df, "id", ["a", "b"], ranges=4, number=lambda c, seed: F.when(seed > 1, F.xxhash64(c, seed)).otherwise(F.length(c).cast("long")))
    for part, want in (("process 1", {i for i in range(600) if i % 3 == 1}), ("chem", set(range(0, 600, 2))), ("c", set(range(600))), ("nowhere", set())):
        for x in (index, clashing):
            x.LISTED = 1000 if part != "c" else 2
            assert sorted(r.id for r in x.keys(part).collect()) == sorted(want), part
