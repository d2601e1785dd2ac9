"""Ranked lexical search against a plain version."""

import collections
import math
import re

import numpy as np

from rolecall.llm import lexical_search
from rolecall.llm.lexical_search import SearchParams

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(docs, items, k):
    counts = [(d, collections.Counter(TERM.findall(lower(t)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, **params):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rank", "'x' as item_id", "map(1, 2) as score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id")
    got = lexical_search.rank_documents(d, i, SearchParams(**params))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


DOCS = [
    (1, "The cat sat; the CAT ran."), (2, "a dog"), (3, None), (4, ""), (5, "... --- !"), (6, "the cat sat the cat ran"), (6, "the cat sat the cat ran"), (None, "the cat sat the cat ran"),
    (7, "ÄpfelÄ café naïve äpfel"), (8, "dog dog dog " * 3000 + "cat"), (9, "x1 y_2 z-3 x1"), (10, "the cat sat the cat ran"),
]
ITEMS = [(1, "Cat the cat"), (2, "dog x1 nowhere"), (3, None), (4, " . "), (5, "ÄpfelÄ CAFÉ"), (None, "y"), (2, "ran"), (6, "absent")]


def test_equals_a_plain_version(spark):
    for k in (1, 2, 50):
        want = plain(DOCS, ITEMS, k)
        assert run(spark, DOCS, ITEMS, k=k) == want
        # blocks of an item or two, tiles of a term and a document or two
        assert run(spark, DOCS, ITEMS, k=k, block_items=2, tile_docs=2, tile_terms=1, salts=3) == want


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    assert run(spark, docs, items, k=7, tile_docs=16, tile_terms=100, block_terms=500) == plain(docs, items, 7)


def test_ties_of_many_rows(spark):
    docs = [(i * 7 % 500, "same words here") for i in range(500)] + [(1000 + i, "other") for i in range(50)]
    got = run(spark, docs, [(1, "words")], k=50, tile_docs=8)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(50))


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, DOCS, []) == [] and run(spark, [(1, None)], ITEMS) == []


def test_partial_sums_stay_exact():
    weights = np.array([50_000] * 400_000, dtype=np.int64)
    cuts = lexical_search.tiles(weights, 1 << 30)
    assert [b for b, _ in cuts[1:]] == [e for _, e in cuts[:-1]] and cuts[-1][1] == len(weights) and len(cuts) > 2
    assert all(int(weights[a:b].sum()) * lexical_search.MOST_IMPACT < lexical_search.EXACT for a, b in cuts)
