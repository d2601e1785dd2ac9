"""Approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt to shards by hash.  Each shard is one graph, built in batches: greedy
beam searches over the graph so far propose neighbours, relaxed distance pruning keeps diverse
edges, and reverse edges are pruned alike.  Every query is searched in every shard of its length
by beam search; a task reads a shard once and the queries stream past it.  All distances are those
of the original vectors in double precision, scaled by a power of two so that none overflows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class GraphParams:
    """``degree`` edges a node; beams of ``build_beam`` and ``search_beam``; pruning relaxed by
    ``alpha``.  A shard holds about ``shard_root`` times the square root of the number of vectors
    of its length, at least ``shard_rows`` and at most ``shard_bytes`` of components, so that work
    and shuffle grow more slowly than the number of shards times that of queries would with a fixed size.
    Up to ``block_rows`` queries are one task's for a shard."""

    degree: int = 32
    build_beam: int = 48
    search_beam: int = 128
    alpha: float = 1.2
    shard_rows: int = 4000
    shard_root: float = 32.0
    shard_bytes: int = 256_000_000
    block_rows: int = 65_536
    batch: int = 256
    entries: int = 16

    def shards(self, n: Column, dim: Column) -> Column:
        most = F.greatest(F.lit(1.0), F.lit(float(self.shard_bytes)) / (8 * dim))
        rows = F.least(most, F.greatest(F.lit(float(self.shard_rows)), F.lit(self.shard_root) * F.sqrt(n)))
        return F.ceil(n / rows).cast("int")


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """Vectors in double precision with components of at most 1, and the power of two taken out."""
    vectors = np.asarray(vectors, dtype=np.float64)
    exponent = int(np.frexp(np.abs(vectors).max())[1]) if vectors.size else 0
    return np.ldexp(vectors, -exponent), exponent


def _distances(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances [q, m] of each query to its own list of nodes; infinite where the id is -1."""
    diff = vectors[ids] - queries[:, None, :]
    out = np.einsum("qmd,qmd->qm", diff, diff)
    out[ids < 0] = np.inf
    return out


def beam_search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all queries in step: ids [q, beam] of the nearest found, nearest first (-1: none), their
    squared distances, and the ids of all nodes that were expanded."""
    n = len(queries)
    ids = np.full((n, beam), -1, dtype=np.int32)
    dist = np.full((n, beam), np.inf)
    first = np.tile(entries[:beam].astype(np.int32), (n, 1))
    d = _distances(vectors, first, queries)
    order = np.argsort(d, axis=1, kind="stable")
    ids[:, : first.shape[1]] = np.take_along_axis(first, order, 1)
    dist[:, : first.shape[1]] = np.take_along_axis(d, order, 1)
    seen = np.zeros((n, beam), dtype=bool)
    expanded = []
    live = np.arange(n)
    while len(live):
        waiting = ~seen[live] & (ids[live] >= 0)
        some = waiting.any(axis=1)
        live, waiting = live[some], waiting[some]
        if not len(live):
            break
        at = waiting.argmax(axis=1)
        node = ids[live, at]
        seen[live, at] = True
        step = np.full(n, -1, dtype=np.int32)
        step[live] = node
        expanded.append(step)
        near = graph[node]
        known = (near[:, :, None] == ids[live][:, None, :]).any(axis=2)
        near = np.where(known, -1, near)
        d = _distances(vectors, near, queries[live])
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_dist = np.concatenate([dist[live], d], axis=1)
        all_seen = np.concatenate([seen[live], np.zeros(near.shape, dtype=bool)], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        dist[live] = np.take_along_axis(all_dist, order, 1)
        seen[live] = np.take_along_axis(all_seen, order, 1)
    return ids, dist, np.stack(expanded, axis=1) if expanded else np.zeros((n, 0), dtype=np.int32)


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges [q, degree] of each node out of its candidates [q, m] (-1: none): again and again the
    nearest left is kept, and those that lie ``alpha`` times nearer to it than to the node go."""
    cand = np.sort(np.where(cand == nodes[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    dist = _distances(vectors, cand, vectors[nodes])
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    points = vectors[cand] - vectors[nodes][:, None, :]
    norm = np.einsum("qmd,qmd->qm", points, points)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    rows = np.arange(len(nodes))
    left = cand >= 0
    for k in range(degree):
        if not left.any():
            break
        best = left.argmax(axis=1)
        ok = left[rows, best]
        out[ok, k] = cand[ok, best[ok]]
        near = between[rows, best]
        left &= ~(alpha * alpha * near <= dist) | ~ok[:, None]
        left[rows, best] = False
    return out


def build_graph(vectors: np.ndarray, params: GraphParams = GraphParams(), seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The graph [n, degree] and its entry nodes (the most central one first)."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    centre = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.r_[centre, order[order != centre]]
    entries = order[: params.entries]
    graph = np.full((n, params.degree), -1, dtype=np.int32)
    done = min(len(entries), n)
    # the entries see each other
    graph[entries] = robust_prune(vectors, entries, np.tile(entries, (done, 1)).astype(np.int32), params.degree, params.alpha)
    while done < n:
        batch = order[done : done + min(params.batch, max(16, done))]
        found, _, path = beam_search(vectors, graph, entries, vectors[batch], params.build_beam)
        edges = robust_prune(vectors, batch, np.concatenate([found, path], axis=1), params.degree, params.alpha)
        graph[batch] = edges
        _add_reverse(vectors, graph, batch, edges, params)
        done += len(batch)
    return graph, _join_lost(vectors, graph, entries.astype(np.int32))


def _reached(graph: np.ndarray, front: np.ndarray, seen: np.ndarray) -> None:
    """Marks in ``seen`` all that can be reached from ``front``."""
    while len(front):
        seen[front] = True
        step = np.unique(graph[front])
        front = step[(step >= 0) & ~seen[step]]


def _join_lost(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Gives each node that no path leads to an edge from the nearest of its own neighbours that
    has room, or makes it an entry; returns the entries."""
    seen = np.zeros(len(graph), dtype=bool)
    _reached(graph, entries, seen)
    more = []
    for node in np.flatnonzero(~seen).tolist():
        if seen[node]:
            continue
        near = graph[node][graph[node] >= 0]
        near = near[seen[near]]
        near = near[np.argsort(((vectors[near] - vectors[node]) ** 2).sum(axis=1), kind="stable")]
        host = next((h for h in near.tolist() if (graph[h] < 0).any()), None)
        if host is None:
            more.append(node)
        else:
            graph[host, np.flatnonzero(graph[host] < 0)[0]] = node
        _reached(graph, np.array([node]), seen)
    return np.r_[entries, np.array(more, dtype=np.int32)].astype(np.int32)


def _add_reverse(vectors: np.ndarray, graph: np.ndarray, batch: np.ndarray, edges: np.ndarray, params: GraphParams) -> None:
    source, target = np.repeat(batch, (edges >= 0).sum(axis=1)).astype(np.int32), edges[edges >= 0]
    gap = ((vectors[source] - vectors[target]) ** 2).sum(axis=1)
    order = np.lexsort((gap, target))
    source, target = source[order], target[order]
    heads, first, count = np.unique(target, return_index=True, return_counts=True)
    nth = np.arange(len(target)) - np.repeat(first, count)
    # a hub's many new edges come in rounds, nearest first; each round is pruned with what is there
    for low in range(0, int(count.max()) if len(count) else 0, 2 * params.degree):
        some = np.flatnonzero(count > low)
        fresh = np.full((len(heads), min(2 * params.degree, int(count.max()) - low)), -1, dtype=np.int32)
        ok = (nth >= low) & (nth < low + fresh.shape[1])
        fresh[np.repeat(np.arange(len(heads)), count)[ok], nth[ok] - low] = source[ok]
        for at in range(0, len(some), params.batch):
            h = some[at : at + params.batch]
            graph[heads[h]] = robust_prune(vectors, heads[h], np.concatenate([graph[heads[h]], fresh[h]], axis=1), params.degree, params.alpha)


def nearest(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, most: int, params: GraphParams) -> np.ndarray:
    """Ids [q, beam] of the nearest found (-1: none): ``most`` and those as near as the last of them.

    A shard no larger than the beam, which would hold it whole, is read whole.
    """
    if len(vectors) <= params.search_beam:
        ids = np.tile(np.arange(len(vectors), dtype=np.int32), (len(queries), 1))
        dist = _distances(vectors, ids, queries)
    else:
        ids, dist, _ = beam_search(vectors, graph, entries, queries, params.search_beam)
    if ids.shape[1] > most:
        edge = np.partition(dist, most - 1, axis=1)[:, most - 1 : most]
        ids = np.where(dist <= edge, ids, -1)
    return ids


def valid_vector(vector: Column) -> Column:
    """Not null or empty, all components finite, and not all of them zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids; more of a group can't be asked for.

    A vector may be that of a third of all rows: its ids are limited within salted parts first.
    """
    salted = rows.select("vec_id", "vector").withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(1024)))
    nth = F.row_number().over(Window.partitionBy("vector", "_salt").orderBy("vec_id"))
    few = salted.withColumn("_nth", nth).where(F.col("_nth") <= keep)
    return few.groupBy("vector").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"))


def build_index(rows: DataFrame, keep: int, params: GraphParams) -> tuple[DataFrame, DataFrame]:
    """The index, one row per shard: dim, shard, n, vectors, graph, entries (packed), ids (an array
    for each vector); and the number of shards of each dim (dim, shards).

    Equal vectors are one, with the ``keep`` least ids; ``rows`` has checked vectors and ids.  An empty
    table gives an empty index.
    """
    distinct = written(distinct_vectors(rows, keep).withColumn("dim", F.size("vector")), "ann-distinct")
    sizes = written(distinct.groupBy("dim").agg(F.count("*").alias("n")).select("dim", params.shards(F.col("n"), F.col("dim")).alias("shards")), "ann-shards")
    total = sizes.agg(F.sum("shards").alias("n")).first()["n"] or 1

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order", kind="stable")
        vectors = np.stack(pdf["vector"].to_numpy())
        graph, entries = build_graph(scaled(vectors)[0], params) if len(vectors) > params.search_beam else (np.zeros((len(vectors), 0), dtype=np.int32), np.zeros(0, dtype=np.int32))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "n": [len(vectors)], "vectors": [vectors.astype(np.float64).tobytes()], "graph": [graph.tobytes()], "entries": [entries.tobytes()], "ids": [[list(x) for x in pdf["ids"]]]})

    dealt = distinct.join(sizes, "dim").withColumn("_order", F.xxhash64("vector", F.lit(3))).withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    packed = dealt.repartition(2 * total, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, n int, vectors binary, graph binary, entries binary, ids array<array<long>>")
    return written(packed, "ann-index"), sizes


class _Shard:
    """One shard, unpacked."""

    def __init__(self, row: pd.Series) -> None:
        self.vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(int(row["n"]), -1)
        self.graph = np.frombuffer(row["graph"], dtype=np.int32).reshape(int(row["n"]), -1)
        self.entries = np.frombuffer(row["entries"], dtype=np.int32)
        self.ids = row["ids"]
        self.work, self.exponent = scaled(self.vectors)

    def ask(self, ids: list[int], points: np.ndarray, k: int, params: GraphParams) -> list[tuple[int, int, float]]:
        """(query, neighbour, distance) of the ``k`` nearest found; an id found twice counts once."""
        out = []
        for at in range(0, len(ids), params.batch):
            some = points[at : at + params.batch]
            # a query far outside the shard's range is as far from all of it; clipping it keeps squares finite
            asked = np.clip(np.ldexp(some, -self.exponent), -1e150, 1e150)
            found = nearest(self.work, self.graph, self.entries, asked, k + 1, params)
            for q, near, point in zip(ids[at : at + params.batch], found, some, strict=True):
                near = near[near >= 0]
                best: dict[int, float] = {}
                for g, i in zip(lengths(self.vectors[near] - point).tolist(), near.tolist(), strict=True):
                    for v in self.ids[i]:
                        if v != q and g < best.get(v, np.inf):
                            best[v] = g
                out += [(q, v, g) for g, v in sorted((g, v) for v, g in best.items())[:k]]
        return out


def lengths(diff: np.ndarray) -> np.ndarray:
    """Euclidean length of each row; rows whose squares would over- or underflow are scaled first."""
    top = np.abs(diff).max(axis=1, initial=0.0)
    plain = (top == 0) | ((top > 1e-140) & (top < 1e140))
    out = np.zeros(len(diff))
    out[plain] = np.sqrt((diff[plain] ** 2).sum(axis=1))
    if not plain.all():
        rest = diff[~plain] / top[~plain][:, None]
        out[~plain] = np.sqrt((rest**2).sum(axis=1)) * top[~plain]
    return out


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, params: GraphParams) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of each of ``queries`` (vec_id, vector).

    A query's own id isn't found; ties go to the smaller id; fewer than ``k`` rows where the index
    has fewer vectors of its length, and none where it has none or there are no queries.
    """
    packed, sizes = index
    totals = sizes.agg(F.sum("shards").alias("n")).first()["n"] or 1
    blocks = max(1, -(-queries.count() // params.block_rows))
    asked = (
        queries.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
        .join(sizes, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    )
    # a task's shard comes first, and its queries after it
    held = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.lit(0))
    cells = held.unionByName(asked.withColumn("part", F.lit(1)), allowMissingColumns=True)
    order = ["dim", "shard", "block"]
    cells = cells.repartition(2 * totals * blocks, *order).sortWithinPartitions(*order, "part", "vec_id")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, shard = None, None
        for batch in batches:
            for at, rows in batch.groupby(order, sort=False):
                is_shard = rows["part"] == 0
                if is_shard.any():
                    cell, shard = at, _Shard(rows[is_shard].iloc[0])
                asking = rows[~is_shard]
                if len(asking) and at == cell:  # a shard that got no vector has no row
                    points = np.stack(asking["vector"].to_numpy()).astype(np.float64)
                    yield pd.DataFrame(shard.ask(asking["vec_id"].astype(int).tolist(), points, k, params), columns=["query_id", "vec_id", "score"])

    found = cells.mapInPandas(find, "query_id long, vec_id long, score double")
    least = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return least.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 10, params: GraphParams = GraphParams(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row among all other rows.

    Nearness is the Euclidean distance of the original vectors in double precision, whatever the
    size of their components; ties go to the smaller vec_id.  Every row with a valid vector is
    indexed; only ``is_query`` rows are looked for.  Vectors that are null, empty, all zero, or
    hold a null or non-finite component take no part, nor do rows with a null id.  Vectors of
    different lengths are not compared.  Equal vectors are one node with the smallest ids;
    repeated rows count once; an id with several vectors is one query and one candidate, at its
    least distance; fewer than ``k`` candidates are all returned; an empty table gives no rows;
    other columns are neither read nor returned.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("_asked")).where(valid_vector(F.col("vector")) & F.col("vec_id").isNotNull())
    index = build_index(rows, k + 1, params)
    return search(index, rows.where("_asked").select("vec_id", "vector").dropDuplicates(["vec_id", "vector"]), k, params)
