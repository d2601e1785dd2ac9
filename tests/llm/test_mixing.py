import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecall.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    t = mixing.targets({"b": 10, "a": 1000, None: 500, "c": 0})
    assert t["b"] == 30 and t["c"] == 0 and sum(t.values()) == pytest.approx(1510)
    # a weighs 5 and null, the fourth, 5 again
    assert t["a"] == t[None] == pytest.approx(740)
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0}
    one = mixing.targets({"a": 7})
    assert one == {"a": 7}


def test_flow_meets_quotas_with_the_fewest_repeats():
    capacity = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    held = {(p, s): n for p, n in capacity.items() for s in p}
    flow = mixing.min_cost_flow(capacity, held, {"a": 120, "b": 100})
    assert sum(n for (_, s), n in flow.items() if s == "a") == 120 and sum(n for (_, s), n in flow.items() if s == "b") == 100
    # 160 tokens once, 60 again; no third pass
    assert all(sum(n for (q, _), n in flow.items() if q == p) <= 2 * c for p, c in capacity.items())
    assert mixing.min_cost_flow({("a",): 10}, {(("a",), "a"): 10}, {"a": 100}) == {(("a",), "a"): 30}
    # two copies of a text in one source: both can be taken, but cost as repeats
    assert mixing.min_cost_flow({("a",): 10}, {(("a",), "a"): 20}, {"a": 100}) == {(("a",), "a"): 60}
    assert mixing.min_cost_flow({}, {}, {}) == {}


def test_flow_is_the_cheapest_of_all():
    def price(n, cap):
        return sum(max(0, min(n - k * cap, cap)) * c for k, c in enumerate((0, 1, 3))) + max(0, n - 3 * cap) * 6

    capacity = {("a",): 2, ("a", "b"): 3, ("b",): 1}
    held = {(("a",), "a"): 2, (("a", "b"), "a"): 3, (("a", "b"), "b"): 4, (("b",), "b"): 1}
    for quota in ({"a": 5, "b": 4}, {"a": 9, "b": 3}, {"a": 0, "b": 12}, {"a": 15, "b": 15}):
        flow = mixing.min_cost_flow(capacity, held, quota)
        assert all(n <= 3 * held[k] for k, n in flow.items())
        got = sum(price(sum(n for (q, _), n in flow.items() if q == p), c) for p, c in capacity.items())
        best = min(
            price(a, 2) + price(quota["a"] - a + b, 3) + price(quota["b"] - b, 1)
            for a in range(min(6, quota["a"]) + 1) for b in range(min(12, quota["b"]) + 1)
            if quota["a"] - a <= 9 and quota["b"] - b <= 3
        )
        assert got == best and sum(flow.values()) == sum(quota.values())


def _brute_target(sizes):
    names = sorted(x for x in sizes if x is not None) + [x for x in sizes if x is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        unit = left / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: 3 * sizes[s] if s in capped else unit * weight[s] for s in names}
        capped |= new


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 50 == 1, F.lit(None)).when(F.col("doc_id") % 100 == 2, "tiny").otherwise(F.col("source")))
    hot = hot.withColumn("text", F.when(F.col("doc_id") == 5, F.lit(None)).when(F.col("doc_id") == 6, F.lit("")).otherwise(F.col("text"))).cache()
    got = {r.doc_id: r for r in mixing.mix_by_source(hot).collect()}
    rows = hot.collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORDS.findall(r.text or ""))
        assert got[r.doc_id]["size"] == n
        sizes[r.source] += n
        taken[r.source] += got[r.doc_id].taken
        largest[r.source] = max(largest[r.source], n)
        assert 0 <= got[r.doc_id].taken <= 3 * n and (n == 0 or got[r.doc_id].taken % n == 0)
    target = _brute_target(sizes)
    for r in rows:
        g = got[r.doc_id]
        assert g.source_size == sizes[r.source] and g.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1, s
    again = {r.doc_id: r for r in mixing.mix_by_source(hot.repartition(7)).collect()}
    assert again == got


def _check_totals(rows, got, levels=3):
    """rows: (doc_id, text, source) with unique doc_id; got: by doc_id, of mix_by_source."""
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, text, source in rows:
        n = len(WORDS.findall(text or ""))
        sizes[source] += n
        taken[source] += got[i].taken
        largest[source] = max(largest[source], n)
        assert 0 <= got[i].taken <= levels * n
    target = _brute_target(sizes)
    patterns = max(1, len({got[i].pattern_sources for i, _, _ in rows}) * 3)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= patterns * (largest[s] / 2 + 1), (s, taken[s], target[s])


def test_overlapping_texts(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    # a fifth of all texts stand in a second source too, and one text a hundred times in three
    rows = docs + [(10_000 + i, t, ("src0", "mirror", None)[i % 3]) for i, t, _ in docs if i % 5 == 0] + [(20_000 + k, "one text that stands everywhere " * 9, ("src0", "mirror", "src1")[k % 3]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_by_source(df, mixing.MixParams(bucket_rows=60)).collect()}
    assert len(got) == len(rows) and sum(r.pattern_sources > 1 for r in got.values()) > 300 and {1, 2, 3} <= {r.pattern_sources for r in got.values()}
    _check_totals(rows, got)
    assert {r.doc_id: r for r in mixing.mix_by_source(df.orderBy(F.desc("doc_id")).repartition(5), mixing.MixParams(bucket_rows=60)).collect()} == got
    # beyond the bounds rows count for their own source alone, and the totals hold
    for params in (mixing.MixParams(patterns=1), mixing.MixParams(width=2)):
        _check_totals(rows, {r.doc_id: r for r in mixing.mix_by_source(df, params).collect()})
    with pytest.raises(ValueError):
        mixing.mix_by_source(df, mixing.MixParams(sources=2))


def test_shared_texts_are_repeated_last(spark):
    # a needs more than it has alone, b less: a text of both is b's to give only where that is cheaper
    rows = [(i, f"own {i} " * 5, "a") for i in range(40)] + [(100 + i, f"both {i} " * 5, s) for i in range(40) for s in ("b", "a")]
    df = spark.createDataFrame([(2 * k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(mixing.rows_of(df), {"a": 600, "b": 200}).collect()
    by_text = defaultdict(int)
    for r in got:
        by_text[r.unit] += r.times
    # 800 words are wanted of 800 in distinct texts: each text once
    assert sorted(by_text.values()) == [1] * 80


def test_edges(spark):
    rows = [(None, "w w", "a"), (None, "w w", "a"), (1, None, "a"), (2, "", "b"), (3, "x y z", None), (3, "x y z", "b"), (3, "other", "b"), (3, "other", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_by_source(df).collect()
    assert len(got) == len(rows) and all(r.taken == 0 for r in got if r.doc_id in (1, 2))
    assert mixing.mix_by_source(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], df.schema)
    assert [r.taken for r in mixing.mix_by_source(empty).collect()] == [0, 0] and mixing.mixed(empty).count() == 0


def test_mixed_takes_rows_of_their_own_source(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 9 + 1), f"s{i % 2}", i, 0, i) for i in range(200)] + [(None, "w w", "s1", 0, 1, 2), (3, "other", "s1", 1, 1, 2), (1, "same text", "s0", 0, 7, 7), (1, "same text", "s1", 0, 7, 7), (1, "same text", "s1", 0, 7, 7)],
        "doc_id long, text string, source string, _times int, _row int, _copy int",
    )
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(mixing.rows_of(docs)).collect():
        taken[r.doc_id, r.source] += r.times * r["size"]
    rows = set(map(tuple, docs.collect()))
    for r in out.collect():
        assert tuple(r) in rows
        got[r.doc_id, r.source] += len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == dict(got)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed(docs.orderBy(F.desc("_row"), "text").repartition(3)).collect()))


def test_all_patterns_are_in_the_flow(spark):
    # more patterns than the driver solves: repeats are spread over shared texts all the same
    texts = [(f"text {i} " + "w " * (5 + i % 7), [f"s{(i + k * (1 + i % 3)) % 7}" for k in range(3)]) for i in range(400)]
    rows = [(t, s) for t, held_by in texts for s in held_by]
    df = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    sizes = defaultdict(int)
    for t, s in rows:
        sizes[s] += len(t.split())
    quota = {s: n / 3 for s, n in sizes.items()}  # as much as the distinct texts hold
    price = {}
    for params in (mixing.MixParams(patterns=3), mixing.MixParams()):
        got = mixing.mix(mixing.rows_of(df), quota, params).collect()
        load, size, taken = defaultdict(int), {}, defaultdict(int)
        for r in got:
            load[r.unit] += r.times
            size[r.unit] = r["size"]
            taken[r.source] += r.times * r["size"]
        assert {r.pattern_sources for r in got} == {3}
        assert all(abs(taken[s] - n) <= 8 for s, n in quota.items())  # half of the longest row
        price[params.patterns] = sum(n * size[u] for u, n in load.items() if n > 1)
    total = sum(size.values())
    assert all(p < 0.15 * total for p in price.values())


def test_every_pass_has_its_price():
    # six rows of a text may be taken three times each: passes beyond the third are spread as well
    capacity = {("a", "b"): 10, ("a", "b", "c"): 10}
    held = {(("a", "b"), "a"): 10, (("a", "b"), "b"): 10, **{(("a", "b", "c"), s): 10 for s in "abc"}}
    flow = mixing.min_cost_flow(capacity, held, {"a": 50, "b": 50, "c": 0})
    assert {p: sum(n for (q, _), n in flow.items() if q == p) for p in capacity} == {p: 50 for p in capacity}


def test_balanced_flow_is_the_cheapest(spark):
    rng = np.random.default_rng(2)
    capacity, held, quota = defaultdict(int), {}, {}
    for _ in range(600):
        p = tuple(f"s{k}" for k in sorted(rng.choice(9, 3, replace=False)))
        capacity[p] += int(rng.integers(5, 400))
    for s in range(9):
        capacity[f"s{s}",] += 500 * s
    capacity = {p: c for p, c in capacity.items() if c}
    held = {(p, s): c for p, c in capacity.items() for s in p}
    of_source = {f"s{k}": sum(n for (_, s), n in held.items() if s == f"s{k}") for k in range(9)}
    quota = {s: round(n) for s, n in mixing.targets(of_source).items()}
    rows = [("|".join(p), s, held[p, s], c) for p, c in capacity.items() for s in p]
    lines = spark.createDataFrame(rows, "pattern string, tag string, held long, capacity long")
    shares = {(tuple(r.pattern.split("|")), r.tag): r.share for r in mixing.balanced_flow(lines, quota, of_source, mixing.MixParams()).collect()}

    def price(flow):
        load = {p: sum(flow[p, s] for s in p) for p in capacity}
        return sum(k * max(0.0, load[p] - k * c) for p, c in capacity.items() for k in range(1, 10))

    got = {key: shares[key] * n for key, n in held.items()}
    # what sources get is what they want, and nothing cheaper gives it
    assert sum(abs(sum(n for (_, t), n in got.items() if t == s) - q) for s, q in quota.items()) < 1e-4 * sum(quota.values())
    best = price(mixing.min_cost_flow(capacity, held, quota))
    assert abs(price(got) - best) < 1e-3 * best
