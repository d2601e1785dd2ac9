import zlib
from collections import defaultdict

import pytest

from rolecall.llm import sharding
from rolecall.llm.sharding import RangePlan, shard_by_bytes


def check(rows, got, shards=8):
    size = {(i, t): len((t or "").encode()) + 1 for i, t in rows}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, size[i, t], zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert len(got) == len(rows) and all(r.law == "bytes" and r.grown_shard is None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, most = sum(r["size"] for r in got), max([r["size"] for r in got], default=0)
    most = max(most, 0.01 * total / shards)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by[k]) - total / shards) <= most
    # equal texts lie in one shard, but for groups larger than the tolerance
    where, held = defaultdict(set), defaultdict(int)
    for r in got:
        where[r.text_crc32, r["size"]].add(r.shard)
        held[r.text_crc32, r["size"]] += r["size"]
    for group, parts in where.items():
        assert held[group] > most or len(parts) == 1
    return by


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = shard_by_bytes(docs).collect()
    by = check(rows, got)
    assert set(by) == set(range(8))
    again = shard_by_bytes(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_larger_tables(spark):
    for name in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
        check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], shard_by_bytes(docs).collect())


@pytest.mark.parametrize("plan", [RangePlan(), RangePlan(rows=10, least=16, draws=1, over=1.5, rounds=6)])
def test_hot_group_nulls_and_long_texts(spark, plan):
    rows = [(i, "copy of one text") for i in range(400)] + [(1000 + i, None) for i in range(300)] + [(2000 + i, "") for i in range(50)]
    rows += [(3000 + i, f"text {i} " * (i % 50)) for i in range(300)] + [(5000, "x" * 60000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    check(rows, shard_by_bytes(docs, plan=plan).collect())


def test_repeated_rows_null_ids_and_few_rows(spark):
    many = [(7, "a")] * 900 + [(None, None)] * 700 + [(i, f"other {i}") for i in range(300)]
    check(many, shard_by_bytes(spark.createDataFrame(many, "doc_id long, text string"), plan=RangePlan(least=32, rows=50)).collect())
    rows = [(7, "a")] * 5 + [(None, "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, shard_by_bytes(docs).collect())
    assert shard_by_bytes(docs.limit(0)).count() == 0
    one = shard_by_bytes(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_repeated_rows_are_parted_into_ranges(spark):
    docs = spark.createDataFrame([(7, "a")] * 4000, "doc_id long, text string").repartition(4)
    keys = docs.selectExpr("doc_id", "1L as size", "1L as text_hash", "2L as id_hash", "monotonically_increasing_id() as row").cache()
    _, stats = sharding._cut(keys, RangePlan(least=40, rows=100))
    assert len(stats) > 20 and max(n for _, n, _ in stats) <= 3 * 4000 / len(stats) + 1


def test_ranges_follow_the_rows():
    plan = RangePlan()
    assert [plan.ranges(n) for n in (0, 10, 10**6, 10**9, 10**11)] == [0, 10, 1024, 5000, 16384]


def test_range_number_counts_cuts(spark):
    cuts = sorted({(h * 7919 % 1001 - 500, h % 13, h % 5) for h in range(300)})
    keys = spark.createDataFrame([(h, i, r) for h in range(-510, 510, 17) for i in (-1, 3, 20) for r in (0, 3)], "text_hash long, id_hash long, row long")
    for r in keys.withColumn("n", sharding._range_number(cuts)).collect():
        assert r.n == sum(c <= (r.text_hash, r.id_hash, r.row) for c in cuts)
