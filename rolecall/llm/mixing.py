"""Mixing overlapping sources to target weights by min-cost flow.

Sources overlap where they hold the same text.  Distinct texts are aggregated by membership
pattern (the set of sources that hold them).  A flow routes each pattern's token capacity to the
sources' quotas; every further repetition of a pattern's texts costs more, so repeats are spread
as evenly as the quotas allow.  All patterns are in the flow: few are solved on the driver, many by
Spark, with one number for each source on the driver.  Within a pattern, each source's rows lie in a
seeded order of the texts, turned so that the sources begin at different places; a row's key says how
far it lies from the end of what the source takes of the pattern, and a source takes rows by their
keys until its quota is met.  Places in the order and quotas come from distributed sums.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, row_hash, text_hash, unit_hash, written

#: Weights of sources in code point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: Numbers of passes at which a balanced flow is held against its bounds, and where sources are parted for these.
PASSES = (1, 2, 3, 4, 6, 8, 16, 32, 64, 256, 1024, 4096)
CUTS = (-8.0, -3.0, -1.0, 0.0, 1.0, 3.0, 8.0)


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Mapping[str | None, int], weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Shares of all sizes by weight; what exceeds ``most`` times a source's size is shared anew
    among the others by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    open_, left = list(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not above:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


@dataclass(frozen=True)
class MixParams:
    """A row is taken ``levels`` times at most.  Buckets of the order hold about ``bucket_rows``
    rows.  Up to ``patterns`` shared patterns, of ``width`` sources and ``passes`` passes on average, the driver finds the
    cheapest flow; of more, of wider ones and of texts with more copies, Spark finds the balanced one (``balanced_flow``, with
    edges as sharp as the ``soft`` ones, one after the other).  More than ``sources`` sources are an error."""

    levels: int = 3
    seed: int = 11
    bucket_rows: int = 1000
    patterns: int = 256
    width: int = 32
    passes: int = 8
    sources: int = 200_000
    soft: tuple[float, ...] = (0.03, 0.01, 0.003)
    miss: float = 1e-5
    gap: float = 1e-4


def min_cost_flow(capacity: Mapping[tuple, int], held: Mapping[tuple, int], quota: Mapping[str | None, int], levels: int = 3) -> dict[tuple, int]:
    """Tokens that each (pattern, source) gives: as much of the quotas as can be met at the least cost.

    ``capacity`` has the tokens of each pattern's distinct texts; ``held`` those of the rows of
    (pattern, source), which can be taken ``levels`` times.  A pattern's first pass costs 0, its
    second 1, its third 3, and so on without an end, as several sources may take it ``levels`` times
    each.  Successive shortest paths with potentials; the graph has a node for each source and
    pattern, and a pattern's way to the sink is priced by the pass that it has come to.
    """
    sources, patterns = list(quota), list(capacity)
    index = {("s", s): i + 2 for i, s in enumerate(sources)} | {("p", p): i + 2 + len(sources) for i, p in enumerate(patterns)}
    graph: list[list[int]] = [[] for _ in range(2 + len(index))]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(a: int, b: int, cap: int, price: int) -> int:
        for x, y, c, w in ((a, b, cap, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(w)
        return len(to) - 2

    for s in sources:
        edge(0, index["s", s], int(quota[s]), 0)
    carried, sink, load, size = {}, {}, {}, {}
    for p in patterns:
        for s in p:
            if s in quota:
                carried[p, s] = edge(index["s", s], index["p", p], levels * int(held[p, s]), 0)
        if capacity[p] > 0:
            a = index["p", p]
            load[a], size[a] = 0, int(capacity[p])
            sink[edge(a, 1, size[a], 0)] = a
    potential = [0] * len(graph)
    while True:
        far: list[float] = [float("inf")] * len(graph)
        back = [-1] * len(graph)
        far[0] = 0
        queue: list[tuple[float, int]] = [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in graph[a]:
                if room[e] > 0 and (new := d + cost[e] + potential[a] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], back[to[e]] = new, e
                    heapq.heappush(queue, (new, to[e]))
        if back[1] < 0:
            break
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        path, a = [], 1
        while a:
            path.append(back[a])
            a = to[back[a] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            if e not in sink:
                room[e ^ 1] += step
            elif room[e] == 0:  # the next pass, at its price; no way leads back from the sink
                a = sink[e]
                load[a] += 1
                room[e], cost[e] = size[a], load[a] * (load[a] + 1) // 2
    return {(p, s): room[e ^ 1] for (p, s), e in carried.items()}


def _pattern_id(tag: Column, combine=lambda c: c) -> list[Column]:
    """Two hashes of a set of sources that don't hang on the order; ``combine`` adds a group's up."""
    return [combine(F.xxhash64(tag, F.lit(k))).alias(f"_h{k}") for k in (1, 2)]


def _patterns(rows: DataFrame) -> DataFrame:
    """unit, pattern (a name), width (its sources) and copies (rows of the unit) of each unit that several sources hold."""
    pairs = rows.groupBy("unit", "tag").agg(F.count("*").alias("copies"))
    shared = pairs.groupBy("unit").agg(F.count("*").cast("int").alias("width"), F.sum("copies").alias("copies"), *_pattern_id(F.col("tag"), F.bit_xor)).where("width > 1")
    return written(shared.select("unit", "width", "copies", F.concat_ws("-", "width", F.hex("_h1"), F.hex("_h2")).alias("pattern")), "mixing-patterns")


class _Packed:
    """Patterns of a batch side by side: for each line the source's number and most tokens, for each pattern its capacity."""

    def __init__(self, batch: pd.DataFrame, levels: int) -> None:
        lens = batch["sources"].map(len).to_numpy()
        self.start = np.cumsum(lens) - lens
        self.own = np.repeat(np.arange(len(lens)), lens)
        self.source = np.concatenate(batch["sources"].to_list()) if len(lens) else np.zeros(0, dtype=np.int64)
        self.most = levels * np.concatenate(batch["held"].to_list()).astype(float) if len(lens) else np.zeros(0)
        self.capacity = batch["capacity"].to_numpy(dtype=float)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.start) if len(self.start) else np.zeros(0)

    def flow(self, level: np.ndarray, soft: float) -> np.ndarray:
        """Tokens of each line, where sources fill patterns up to about their own ``level``, log(1 + passes)."""
        mine = level[self.source]

        def at(x: np.ndarray) -> np.ndarray:
            return self.most / (1 + np.exp(np.clip((x[self.own] - mine) / soft, -60, 60)))

        low, high = np.zeros(len(self.start)), np.log1p(self.sums(self.most) / self.capacity)
        for _ in range(45):  # halves the range each time
            x = (low + high) / 2
            over = self.sums(at(x)) > self.capacity * np.expm1(x)
            low, high = np.where(over, x, low), np.where(over, high, x)
        return at((low + high) / 2)

    def within(self, level: np.ndarray, soft: float, passes: Sequence[int], cuts: Sequence[float]) -> np.ndarray:
        """[passes, 1 + cuts]: the tokens of the flow that lie within so many passes of the patterns, and the most that the
        sources with a level above each cut (in edges from that of so many passes) can place there."""
        load, mine, out = self.sums(self.flow(level, soft)), level[self.source], np.zeros((len(passes), 1 + len(cuts)))
        for row, k in zip(out, passes, strict=True):
            above = (np.where(mine > np.log1p(k) + c * soft, self.most, 0.0) for c in cuts)
            row[:] = [np.minimum(x, k * self.capacity).sum() for x in (load, *map(self.sums, above))]
        return out


def _levelled(missing: Callable[[np.ndarray], np.ndarray], level: np.ndarray, scale: np.ndarray, enough: float, memory: int = 20) -> np.ndarray:
    """Levels at which ``missing``, what sources want less what they get, sums to ``enough`` at most.

    Quasi-Newton steps: what is missing is the slope of a concave function of the levels, so a step
    along which the slope turns back was too long, and one along which it hardly falls too short.
    ``scale`` is a safe step for each token missing.  Ends too when steps no longer help.
    """
    short = missing(level)
    best, chosen, stale = float(np.abs(short).sum()), level, 0
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    while best > enough and stale < 20:
        way, used = short.copy(), []
        for move, fall in reversed(moves):
            used.append((move @ way) / (move @ fall))
            way = way - used[-1] * fall
        way = way * scale * ((moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ (scale * moves[-1][1])) if moves else 1.0)
        for (move, fall), part in zip(moves, reversed(used), strict=True):
            way = way + (part - (fall @ way) / (move @ fall)) * move
        slope, furthest = float(short @ way), float(np.abs(way).max())
        low, high, length = 0.0, math.inf, min(1.0, 1.0 / furthest)
        for _ in range(12):
            new = level + length * way
            later = missing(new)
            if later @ way < -0.9 * slope:
                high = length
            elif later @ way > 0.9 * slope and length * furthest < 4:
                low = length
            else:
                break
            length = 2 * length if high == math.inf else (low + high) / 2
        move, fall = new - level, short - later
        if move @ fall > 1e-12 * np.linalg.norm(move) * np.linalg.norm(fall):
            moves = [*moves, (move, fall)][-memory:]
        level, short = new, later
        miss = float(np.abs(short).sum())
        stale = 0 if miss < 0.99 * best else stale + 1
        if miss < best:
            best, chosen = miss, level
    return chosen


def balanced_flow(lines: DataFrame, wanted: Mapping[str, int], held: Mapping[str, int], params: MixParams) -> DataFrame:
    """pattern, tag, share (flow by held tokens) and turn (share of the capacity that the sources before it take).

    ``lines`` has pattern, tag, held and capacity (positive) of any number of patterns of any width.
    Each source has one level of repetition and fills its patterns up to it; the levels are those at
    which all sources get what they want, but for ``miss`` of it in all.  So patterns are repeated as evenly as the quotas allow,
    which has the least sum of any price that rises with the passes.  That is proved, not hoped for: for any number of passes
    no flow places more within them than the sources at or below that level want, and the others can place there.  The edge of the
    levels is made sharper until the flow lacks less than ``gap`` of all words of these bounds, or is as sharp as it gets.
    Spark works out the patterns; the driver holds a number for each source.
    """
    spark, levels = lines.sparkSession, params.levels
    tags = sorted(wanted)
    index = written(spark.createDataFrame([(t, i) for i, t in enumerate(tags)], "tag string, _i int"), "mixing-index")
    packed = lines.join(index, "tag").groupBy("pattern", "capacity").agg(F.array_sort(F.collect_list(F.struct("_i", "held"))).alias("_l"))
    packed = written(packed.select("pattern", "capacity", F.col("_l._i").alias("sources"), F.col("_l.held").alias("held")), "mixing-packed")
    most = levels * np.array([held[t] for t in tags], dtype=float)
    want = np.minimum(np.array([wanted[t] for t in tags], dtype=float), most)
    # who wants nothing or all has no level to look for
    fixed = np.where(want >= most * (1 - 1e-6), 1e3, np.where(want <= most * 1e-6, -1e3, 0.0))

    def summed(of_part: Callable[[_Packed], np.ndarray], size: int) -> np.ndarray:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for batch in batches:
                total += of_part(_Packed(batch, levels))
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at, "n": total[at]})

        out = np.zeros(size)
        for r in packed.select("capacity", "sources", "held").mapInPandas(add, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():
            out[r["i"]] = r["n"]
        return out

    def got(level: np.ndarray, soft: float) -> np.ndarray:
        return summed(lambda part: np.bincount(part.source, weights=part.flow(level, soft), minlength=len(level)), len(level))

    def lacking(level: np.ndarray, soft: float) -> float:
        inside = summed(lambda part: part.within(level, soft, PASSES, CUTS).ravel(), len(PASSES) * (1 + len(CUTS))).reshape(len(PASSES), -1)
        below = np.array([[want[level <= np.log1p(k) + c * soft].sum() for c in CUTS] for k in PASSES])
        return float(((below + inside[:, 1:]).min(axis=1) - inside[:, 0]).max())

    chosen = np.where(fixed == 0, np.log1p(levels * want / np.maximum(most, 1)), fixed)
    for soft in params.soft:
        scale = np.where(most > 0, 4 * soft / np.maximum(most, 1), 0.0)
        chosen = _levelled(lambda level, soft=soft: np.where(fixed == 0, want - got(level, soft), 0.0), chosen, scale, params.miss * want.sum())
        if soft == params.soft[-1] or lacking(chosen, soft) <= params.gap * want.sum():
            break

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = _Packed(batch, levels)
            n = part.flow(chosen, soft)
            before = np.cumsum(n) - n
            turn = (before - before[part.start][part.own]) / part.capacity[part.own] if len(n) else n
            yield pd.DataFrame({"pattern": batch["pattern"].to_numpy()[part.own], "_i": part.source.astype(np.int32), "share": levels * n / part.most, "turn": turn})

    shares = packed.mapInPandas(share, "pattern string, _i int, share double, turn double")
    return written(shares.join(index, "_i").drop("_i"), "mixing-shares")


def _placed(rows: DataFrame, params: MixParams) -> DataFrame:
    """Adds ``_mid``: twice the middle of each row's size in its group's order (``_order``, 0 to 1).

    Rows go to buckets of the order, of about ``bucket_rows`` each; the sums before a bucket come
    from a line for each bucket, those inside it from its own rows.
    """
    counts = rows.groupBy("pattern", "tag").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / params.bucket_rows)).alias("_buckets"))
    rows = written(rows.join(written(counts, "mixing-buckets"), ["pattern", "tag"]).withColumn("_bucket", F.floor(F.col("_order") * F.col("_buckets"))), "mixing-rows")
    ahead = Window.partitionBy("pattern", "tag").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("pattern", "tag", "_bucket").agg(F.sum("size").alias("_sum")).select("pattern", "tag", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("pattern", "tag", "_bucket").orderBy("_order", "doc_id", "unit", "tie", "size")
    rows = rows.withColumn("_upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(written(before, "mixing-before"), ["pattern", "tag", "_bucket"]).withColumn("_mid", 2 * (F.col("_before") + F.col("_upto")) - F.col("size"))


def _tag(source: Column) -> Column:
    """A source's name with a mark before it, and another mark for null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _source(tag: str) -> str | None:
    return tag[1:] if tag[0] == "s" else None


def _cuts(copies: DataFrame, wanted: DataFrame, params: MixParams) -> DataFrame:
    """tag and _cut: the key of the first copy that a source doesn't take, no row for one that takes all; copies
    (tag, key, size) are taken by their keys until the middle of the next one lies beyond what is ``wanted``."""
    lowest, span = -float(params.levels), 2.0 * params.levels
    bucket = F.floor((F.col("key") - lowest) / span * F.col("_buckets"))
    cells = copies.join(wanted, "tag").withColumn("_bucket", bucket)
    sums = written(cells.groupBy("tag", "wanted", "_bucket").agg(F.sum("size").alias("_sum")), "mixing-cells")
    upto = F.sum("_sum").over(Window.partitionBy("tag").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    full = sums.withColumn("_upto", upto).where(F.col("_upto") <= F.col("wanted")).groupBy("tag").agg(F.max("_bucket").alias("_last"), F.max("_upto").alias("_before"))
    # the next copy lies in the next bucket that has any
    rest = sums.join(full, "tag", "left").where(F.col("_bucket") > F.coalesce("_last", F.lit(-1)))
    edge = written(rest.groupBy("tag").agg(F.min("_bucket").alias("_bucket"), F.min(F.struct("_bucket", F.coalesce("_before", F.lit(0)).alias("v")))["v"].alias("_before")), "mixing-edges")
    inside = Window.partitionBy("tag").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = cells.join(edge, ["tag", "_bucket"]).withColumn("_mid", F.col("_before") + F.sum("size").over(inside) - F.col("size") / 2)
    first = near.groupBy("tag", "_bucket", "_buckets").agg(F.min(F.when(F.col("_mid") >= F.col("wanted"), F.col("key"))).alias("_key"))
    return first.select("tag", F.coalesce("_key", (F.col("_bucket") + 1) / F.col("_buckets") * span + lowest).alias("_cut"))


def mix(rows: DataFrame, quota: Mapping[str | None, float] | None = None, params: MixParams = MixParams()) -> DataFrame:
    """One row per row of ``rows``: doc_id, unit, source, size, tie, pattern_sources, source_size, target, times.

    ``rows`` has doc_id, ``unit`` (what the row holds; rows with one unit repeat each other),
    ``source``, ``size`` (long, the same for all rows of a unit) and ``tie`` (a long that parts rows
    with one doc_id and unit).  ``quota`` is the size wanted of each source, by default ``targets`` of the
    sources' sizes; sources without a quota give nothing.  ``times`` is how often the mix takes
    the row, at most ``levels``, and ``pattern_sources`` how many sources share its pattern (1
    where the unit is in no other source).  What a source takes in all is within half a row of its
    quota, as far as its rows reach, whatever the number of patterns.  A null source is a source of its own, a
    null size counts 0, null ids are ordered by unit and tie; rows equal in all of doc_id, unit,
    source and tie get the same number of takings between them on every run, however they are
    dealt.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = written(rows.select("doc_id", "unit", _tag(F.col("source")).alias("tag"), "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "tie"), "mixing-units")
    alone = F.concat_ws("-", F.lit(1), *[F.hex(c) for c in _pattern_id(F.col("tag"))])
    rows = written(rows.join(_patterns(rows), "unit", "left").withColumns({"pattern": F.coalesce("pattern", alone), "width": F.coalesce("width", F.lit(1))}), "mixing-by-pattern")
    units = rows.groupBy("unit", "pattern").agg(F.max("size").alias("size")).groupBy("pattern").agg(F.sum("size").alias("capacity"))
    lines = rows.groupBy("pattern", "tag", "width").agg(F.sum("size").alias("held"), F.count("*").alias("rows"))
    lines = written(lines.join(units, "pattern"), "mixing-held")
    of_tag = lines.groupBy("tag").agg(F.sum("held").alias("held"), F.sum("rows").alias("rows"), F.max("width").alias("width")).limit(params.sources + 1).collect()
    if len(of_tag) > params.sources:
        raise ValueError(f"more than {params.sources} sources")
    sizes = {_source(r["tag"]): r["held"] for r in of_tag}
    if quota is None:
        quota = targets(sizes, most=params.levels)
    wanted = {r["tag"]: round(quota.get(_source(r["tag"]), 0)) for r in of_tag}
    # written, so that the planner knows how small it is
    sources = spark.createDataFrame(
        [(r["tag"], r["held"], float(quota.get(_source(r["tag"]), 0.0)), wanted[r["tag"]], max(1, -(-params.levels * r["rows"] // params.bucket_rows))) for r in of_tag],
        "tag string, source_size long, target double, wanted long, _buckets long",
    )
    sources = written(sources, "mixing-sources")
    # sources that share no pattern need no flow: they take what they want of their own
    meet = written(spark.createDataFrame([(r["tag"],) for r in of_tag if r["width"] > 1], "tag string"), "mixing-meet")
    part = written(lines.where("held > 0").join(meet, "tag", "left_semi"), "mixing-met")
    free = lines.where("held > 0").join(meet, "tag", "left_anti").join(sources, "tag").select("pattern", (F.col("wanted") / F.col("held")).alias("share"), F.lit(0.0).alias("turn"), "tag")
    shared = part.where("width > 1")
    few = shared.limit(params.patterns * params.width + 1).count() <= params.patterns * params.width and shared.select("pattern").distinct().limit(params.patterns + 1).count() <= params.patterns
    few = few and (part.agg(F.sum(params.levels * F.col("held") / F.col("capacity"))).first()[0] or 0) <= params.patterns * params.passes
    if few:
        got = sorted(part.collect(), key=lambda r: (r["pattern"], r["tag"]))
        members: dict[tuple, list] = {}
        for r in got:
            members.setdefault(r["pattern"], []).append(r)
        names = {p: tuple(r["tag"] for r in ls) + (() if len(ls) > 1 else (p,)) for p, ls in members.items()}
        capacity = {names[p]: ls[0]["capacity"] for p, ls in members.items()}
        flow = min_cost_flow(capacity, {(names[r["pattern"]], r["tag"]): r["held"] for r in got}, {r["tag"]: wanted[r["tag"]] for r in of_tag if r["width"] > 1}, params.levels)
        plan = []
        for p, ls in members.items():
            turn = 0
            for r in ls:
                n = flow[names[p], r["tag"]]
                plan.append((p, n / r["held"], turn / r["capacity"], r["tag"]))
                turn += n
        shares = spark.createDataFrame(plan, "pattern string, share double, turn double, tag string")
    else:
        want = {r["tag"]: wanted[r["tag"]] for r in of_tag if r["width"] > 1}
        shares = balanced_flow(part, want, {r["tag"]: r["held"] for r in of_tag if r["width"] > 1}, params).select("pattern", "share", "turn", "tag")
    of_pattern = lines.groupBy("pattern").agg(F.sum("rows").alias("_rows"))
    table = lines.select("pattern", "tag", "held").join(of_pattern, "pattern").join(shares.unionAll(free), ["pattern", "tag"], "left").fillna(0.0, ["share", "turn"])
    # a unit of many rows takes up its share of the order, so that none is a hot place in it
    spread = F.when(F.col("copies") > F.col("width"), F.least(F.lit(1.0), F.col("copies") / F.col("_rows"))).otherwise(0.0)
    alike = F.pmod(unit_hash(F.col("unit"), params.seed) + spread * unit_hash(F.struct("doc_id", "tie"), params.seed + 1), F.lit(1.0))
    own = unit_hash(F.struct("doc_id", "unit", "tie"), params.seed)
    placed = _placed(rows.join(written(table, "mixing-plan"), ["pattern", "tag"]).withColumn("_order", F.when(F.col("width") > 1, alike).otherwise(own)), params)
    # a source begins where the one before it in the pattern ended; patterns of few rows are turned, so that their cuts differ
    turned = unit_hash(F.col("pattern"), params.seed + 2) + F.col("_mid") / (2 * F.greatest(F.col("held"), F.lit(1))) - F.col("turn")
    placed = written(placed.withColumn("_key", F.pmod(turned, F.lit(1.0)) - F.col("share")).select("doc_id", "unit", "tag", "source", "size", "tie", F.col("width").alias("pattern_sources"), "_key"), "mixing-keys")
    copy = F.explode(F.sequence(F.lit(0), F.lit(params.levels - 1)))
    copies = placed.where("size > 0").select("tag", "size", "_key", copy.alias("_k")).select("tag", "size", (F.col("_key") + F.col("_k")).alias("key"))
    cut = written(_cuts(copies, sources.select("tag", "wanted", "_buckets"), params), "mixing-cuts")
    times = F.size(F.filter(F.sequence(F.lit(0), F.lit(params.levels - 1)), lambda k: k + F.col("_key") < F.coalesce("_cut", F.lit(float(params.levels)))))
    out = placed.join(sources.select("tag", "source_size", "target"), "tag").join(cut, "tag", "left")
    return out.select("doc_id", "unit", "source", "size", "tie", "pattern_sources", "source_size", "target", F.when(F.col("size") > 0, times).otherwise(0).alias("times"))


def rows_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of documents for ``mix``: a text is the unit, sized by words; a row's hash parts ties.

    A null text is a unit of its own, of size 0; ids and sources may be null.  One row per row of
    ``docs``, none for an empty table; columns of any further names only go into the hash.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("unit"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(docs).alias("tie"))


def mix_by_source(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source_size, target, taken, times, pattern_sources.

    Null and empty texts have size 0 and are not taken; a null source is a source; repeated rows,
    null ids, ties, an empty table and bounds are as ``mix`` has them; other columns only tell
    rows of one id, text and source apart.
    """
    return mix(rows_of(docs), None, params).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "pattern_sources")


def mixed(docs: DataFrame, params: MixParams = MixParams(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix by source takes them: each row as often as taken, with its columns.

    A row is known by the hash of all its columns, next to id, text and source; what exactly
    repeated rows are taken for is given to one of them, so reruns agree.  Null and empty texts
    are never taken.  An empty table gives no rows; further columns of any name are kept.
    """
    keys = ["doc_id", "unit", "source", "tie"]
    taken = mix(rows_of(docs, doc_id, text, source), None, params).groupBy(*keys).agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("rows"))
    taken = written(taken.where("times > 0").select(F.struct(F.col("unit"), F.col("tie"), _tag(F.col("source")), F.col("doc_id").isNull(), F.xxhash64("doc_id")).alias("key"), "times", "rows"), "mixing-times")
    key, times, copy = free_names(docs, "_row", "_times", "_copy")
    rows = docs.withColumn(key, F.struct(text_hash(F.col(text)), row_hash(docs), _tag(F.col(source)), F.col(doc_id).isNull(), F.xxhash64(F.col(doc_id))))
    listed = lambda which: taken.where(which).select(F.col("key").alias(key), F.col("times").alias(times))
    once = rows.join(listed("rows = 1"), key).unionAll(rows.join(listed("rows > 1"), key).dropDuplicates([key]))
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times, copy)
