import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from rolecall.llm import ngram_join as nj


def brute(rows, n=5, threshold=0.8):
    sets = []
    for i, t in rows:
        w = (t or "").encode().split() if i is not None else []
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in inverted[g]:
                if j > i:
                    common[j] += 1
        for j, c in common.items():
            if c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                parent[a] = b
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = top(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, least.get(top(i)) if doc is not None else None, links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, nj.near_duplicates(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    assert got == sorted(con.execute(nj.oracle_sql()).fetchall(), key=str)


@pytest.mark.parametrize("block", [16, 1024])
def test_groups_copies_and_edges(spark, block):
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(90):  # near copies, each with an edit
        w = list(base)
        w[rnd.randrange(120)] = f"edit{i}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base)) for i in range(60)] + [(i, f"short {i % 3}") for i in range(12)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (None, " ".join(base)), (3000, "z " * 20000), (3001, "z " * 30000), (2000, " ".join(base))]
    rows += [(4000 + i, " ".join(f"u{rnd.randrange(9999)}" for _ in range(50))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    got = sorted(map(tuple, nj.near_duplicates(docs, nj.JoinParams(block=block)).collect()), key=str)
    assert got == brute(rows)
    kept = nj.keep_one(docs, nj.JoinParams(block=block))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {None, 5000, 5001, 5002, 1000, 3000, 0, 1, 2}.issubset(ids) and not {1001, 2000, 2001, 3001, 3}.intersection(ids)
    assert nj.near_duplicates(docs.limit(0)).count() == 0


def test_rows_decide_where_ids_repeat(spark):
    a, b = "one text of some six words here", "another text of quite some other words"
    rows = [(1, a, "x"), (1, a, "x"), (5, a, "y"), (5, b, "y"), (7, b, "z"), (7, b, "w"), (None, a, "n"), (None, a, "n"), (8, None, "e"), (8, None, "e"), (9, " ", "e")]
    docs = spark.createDataFrame([(*r, 1, 2, {"k": 1}) for r in rows], "doc_id long, text string, lang string, _gone int, _row int, extra map<string,int>")
    out = nj.keep_one(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text or "", r.lang) for r in out.collect())
    # one row of text A, the row of text B with the least id, and all rows without words or id
    assert kept == sorted([(1, a, "x"), (5, b, "y"), (0, a, "n"), (0, a, "n"), (8, "", "e"), (8, "", "e"), (9, " ", "e")])
    assert kept == sorted((r.doc_id or 0, r.text or "", r.lang) for r in nj.keep_one(docs.orderBy("lang", ascending=False).repartition(3)).collect())
    judged = sorted(map(tuple, nj.near_duplicates(docs).collect()), key=str)
    assert judged == brute([r[:2] for r in rows])
    two = [(1, a), (2, a), (3, b), (3, a + " x"), (4, b), (1, b)]  # ids that come with several texts
    assert sorted(map(tuple, nj.near_duplicates(spark.createDataFrame(two, "doc_id long, text string")).collect()), key=str) == brute(two)


def test_many_repeats_of_one_row(spark):
    base = [f"w{k}" for k in range(300)]
    near = [*base[:-1], "edit"]
    docs = spark.range(200_000).selectExpr("7L as doc_id", f"'{' '.join(base)}' as text").unionAll(spark.createDataFrame([(9, " ".join(near))], "doc_id long, text string"))
    got = {tuple(r): r["count"] for r in nj.near_duplicates(docs).groupBy("doc_id", "class_id", "n_links").count().collect()}
    assert got == {(7, 7, 200_000, 200_000): 200_000, (9, 7, 200_000, 1): 1}
    assert [r.doc_id for r in nj.keep_one(docs).collect()] == [7]


def test_blocks_are_bounded_by_grams(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(2000)]
    rows = []
    for i in range(24):
        w = list(base)
        w[rnd.randrange(2000)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), nj.JoinParams(block_grams=5000))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_filter_marks_all_that_match(spark):
    from pyspark.sql import functions as F

    from rolecall.llm.common import marked

    wanted = spark.range(0, 3000, 3)
    df = spark.range(20_000).selectExpr("id as _bucket", "id as _at", "id as _bits")
    got = marked(df, "flag", F.col("_at"), wanted, F.col("id"))
    assert got.columns == [*df.columns, "flag"]
    hit = {r._at for r in got.where("flag").collect()}
    assert set(range(0, 3000, 3)) <= hit and len(hit) < 1100
    assert marked(df, "flag", F.col("_at"), wanted.limit(0), F.col("id")).where("flag").count() == 0


def test_banding_reaches_recall():
    for t, recall in ((0.8, 0.999), (0.9, 0.99), (1.0, 0.9)):
        bands, rows = nj.JoinParams(threshold=t, recall=recall).bands_rows
        assert 1 - (1 - t**rows) ** bands >= recall - 1e-12 and bands * rows <= 150
    with pytest.raises(ValueError):
        _ = nj.JoinParams(threshold=0.01, hashes=10).bands_rows


def test_matrix_and_merge_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert nj._common(sets, i, j).tolist() == want
    assert nj._common(sets, i[:10], j[:10]).tolist() == want[:10]


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in nj.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}
