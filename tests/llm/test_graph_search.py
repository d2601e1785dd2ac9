import math

import numpy as np
import pytest

from rolecall.llm import graph_search as gs


def brute(rows, k=10):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ok = list({(i, v.tobytes()): (i, v) for i, v in ok}.values())
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            found = sorted((math.hypot(*(w - v)), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [(i, d) for d, i in found[:k]]
    return out


def run(spark, rows, kind="float", **params):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, score int")
    out = {}
    for r in gs.nearest_neighbours(table, F.col("vec_id") % 100 == 0, params=gs.GraphParams(**params)).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, d) for _, i, d in v] for q, v in out.items()}


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_and_exact_scores(spark, name):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").collect()]
    want, got = brute(rows), run(spark, rows, shard_rows=700, shard_root=1)
    assert set(want) == set(got)
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want]
    assert sum(hits) / sum(map(len, want.values())) > 0.9
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    assert all(d == pytest.approx(float(np.linalg.norm(vectors[q] - vectors[i])), abs=1e-12) for q, v in got.items() for i, d in v)


def test_small_tables_are_exact_with_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 250)]
    rows += [(i, [float(i), 1.0]) for i in range(300, 340)] + [(300, [300.0, 1.0])]
    rows += [(500, None), (501, [0.0, 0.0]), (502, [1.0, None]), (600, [float("nan"), 1.0]), (601, [float("inf"), 1.0]), (700, []), (None, [1.0, 2.0])]
    rows += [(800, [1.0, 0.0, 0.0]), (801, [1.0, 1.0, 0.0])]
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want) == {0, 100, 200, 300, 800}
    assert got == {q: [(i, pytest.approx(d, abs=1e-12)) for i, d in v] for q, v in want.items()}
    assert len(got[800]) == 1


def test_blocks_of_queries(spark):
    rng = np.random.default_rng(1)
    rows = [(100 * i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    assert {q: [i for i, _ in v] for q, v in run(spark, rows, block_rows=7, shard_rows=13, shard_root=1).items()} == {q: [i for i, _ in v] for q, v in brute(rows).items()}


@pytest.mark.parametrize(("kind", "scale"), [("float", 1e-20), ("float", 1e-38), ("float", 1e20), ("float", 1e30), ("float", 3e38), ("double", 1.0), ("double", 1e-200), ("double", 1e200)])
def test_any_size_of_components(spark, kind, scale):
    rng = np.random.default_rng(3)
    made = rng.uniform(-1, 1, size=(450, 6)) * scale
    rows = [(i, (v.astype(np.float32) if kind == "float" else v).tolist()) for i, v in enumerate(made)]
    want, got = brute(rows), run(spark, rows, kind)
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want}
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.9 * 10 * len(want)
    exact = {q: dict(v) for q, v in want.items()}
    assert all(d == pytest.approx(exact[q][i], rel=1e-12) for q, v in got.items() for i, d in v if i in exact[q])


def test_near_doubles_and_mixed_sizes(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=5)
    rows = [(i, (base + rng.normal(size=5) * 1e-12).tolist()) for i in range(400)]
    rows += [(1000 + i, (rng.normal(size=5) * 10.0 ** rng.integers(-30, 30)).tolist()) for i in range(300)]
    want, got = brute(rows), run(spark, rows, "double")
    assert set(got) == set(want)
    # seen from a large vector all small ones are equally far but for the last digits: distances count, not ids
    assert sum(d <= want[q][-1][1] * (1 + 1e-6) for q in want for _, d in got[q]) >= 0.9 * 10 * len(want)
    assert all(d > 0 for q in (0, 100, 200, 300) for _, d in got[q])


def test_ties_and_ids_with_several_vectors(spark):
    rows = [(i, [float(1 + i // 20 % 20), float(1 + i % 20)]) for i in range(400)]  # a grid, many equal distances
    assert run(spark, rows) == {q: [(i, pytest.approx(d)) for i, d in v] for q, v in brute(rows).items()}
    two = [(0, [1.0, 1.0]), (0, [9.0, 9.0]), (1, [1.0, 2.0]), (1, [50.0, 50.0]), (2, [9.0, 9.5]), (2, [9.0, 9.5])]
    assert run(spark, two) == {0: [(2, 0.5), (1, 1.0)]}


def test_recall_with_the_parameters_of_the_query(spark):
    params = gs.GraphParams(shard_rows=2000, shard_root=1)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(8000, 16)).astype(np.float32).tolist())]
    want, got = brute(rows), run(spark, rows, shard_rows=params.shard_rows, shard_root=params.shard_root)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}


def test_prune_keeps_diverse_edges():
    vectors = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1.5], [9, 9]], dtype=np.float32)
    kept = gs.robust_prune(vectors, np.array([0]), np.array([[0, 1, 2, 3, -1, 2]], dtype=np.int32), 4, 1.2)
    assert kept.tolist() == [[1, 3, -1, -1]]
