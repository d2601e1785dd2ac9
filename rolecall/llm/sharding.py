"""Sharding by sampled splitters.

Records are ordered by (hash of the text, hash of the id, row number), so equal texts lie together
and even repeated rows can be parted.  A sample of keys, drawn with weights by size, gives quantile
boundaries that part the keys into ranges; ranges that turn out overfull are sampled again and
subdivided.  Sums over the ranges and running sums inside each give every record its exact place
in bytes and in rows, from which shards of near-equal bytes and gapless slots follow; a shard ends
at the edge of a group of equal texts, unless the group is too large for that.  All of it is
DataFrame work; the driver sees only the sample, one line for each range, both bounded by
parameters, and one line for each of the groups where a shard ends.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit_hash, written

#: Hash of a text, hash of an id, and row number.
Key = tuple[int, int, int]
KEY = ("text_hash", "id_hash", "row")


@dataclass(frozen=True)
class RangePlan:
    """A range is to hold ``rows`` rows, and there are ``least`` to ``most`` ranges; ``draws`` keys
    for each range are drawn in each round; a range is overfull beyond ``over`` times the mean in
    rows or bytes, and at most ``rounds`` subdivisions follow.  A group of equal texts is parted
    by a shard's end if it is larger than ``tolerance`` of a shard and than the largest record."""

    rows: int = 200_000
    least: int = 1024
    most: int = 16_384
    draws: int = 8
    over: float = 3.0
    rounds: int = 4
    tolerance: float = 0.01

    def ranges(self, rows: int) -> int:
        return min(rows, max(self.least, min(self.most, rows // self.rows)))


def _weighted_sample(keys: DataFrame, weight: Column, total: float, most: int, seed: int) -> list[Key]:
    """At most ``most`` keys without replacement, likelier by weight (exponential ranks).

    ``total`` is the sum of the weights: about four times ``most`` ranks lie below the bound, so
    what all tasks together send stays near that, however many they are.
    """
    rank = -F.log(unit_hash(F.struct(*KEY), seed)) / weight
    rows = keys.select(*KEY, rank.alias("_rank")).where(F.col("_rank") <= 4 * most / total).orderBy("_rank", *KEY).limit(most).collect()
    return [tuple(r[c] for c in KEY) for r in rows]


def _quantiles(keys: list[Key], parts: int) -> list[Key]:
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _range_number(cuts: list[Key]) -> Column:
    """How many cuts are at or before the row's key: found among every 32nd cut, then between."""
    if not cuts:
        return F.lit(0)
    key = F.struct(*[F.col(c).alias(n) for c, n in zip(KEY, "hir", strict=True)])
    blocks = [[dict(zip("hir", cut, strict=True)) for cut in cuts[at : at + 32]] for at in range(0, len(cuts), 32)]
    # as text, parsed once: the optimizer folds it into one constant
    inner = F.from_json(F.lit(json.dumps(blocks)), "array<array<struct<h:long,i:long,r:long>>>")
    heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<struct<h:long,i:long,r:long>>")
    before = F.size(F.filter(heads, lambda c: c <= key))
    within = F.size(F.filter(F.element_at(inner, F.greatest(before, F.lit(1))), lambda c: c <= key))
    return F.when(before == 0, 0).otherwise((before - 1) * 32 + within)


def _cut(keys: DataFrame, plan: RangePlan) -> tuple[list[Key], list[tuple[int, int, int]]]:
    """Boundaries, and (range, rows, bytes) of the ranges that have rows."""
    total = keys.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, size = total["n"], total["b"] or 0
    if not n:
        return [], []
    # half the weight by bytes and half by rows, so that neither many tiny nor a few huge texts fill a range
    weight = F.col("size") / F.lit(float(size)) + F.lit(1.0 / n)
    ranges = plan.ranges(n)
    sample = plan.draws * ranges
    cuts = _quantiles(_weighted_sample(keys, weight, 2.0, sample, 1), ranges)
    for round_ in range(plan.rounds + 1):
        stats = keys.groupBy(_range_number(cuts).alias("range")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
        parts = max(1, len(cuts))
        share = {r["range"]: max(r["n"] / n, r["b"] / size) * parts for r in stats}
        overfull = [r["range"] for r in stats if share[r["range"]] > plan.over and r["n"] > 1]
        if not overfull or round_ == plan.rounds:
            break
        inside = keys.withColumn("_range", _range_number(cuts)).where(F.col("_range").isin(overfull))
        held = sum(r["n"] / n + r["b"] / size for r in stats if r["range"] in set(overfull))
        extra = _weighted_sample(inside, weight, held, sample, 2 + round_)
        by_range: dict[int, list[Key]] = {}
        for key in extra:
            by_range.setdefault(bisect.bisect_right(cuts, key), []).append(key)
        grown = sorted({*cuts, *(c for r, found in by_range.items() for c in _quantiles(found, min(len(found), 1 + int(share[r]))))})
        if grown == cuts:
            break
        cuts = grown
    return cuts, sorted((r["range"], r["n"], r["b"]) for r in stats)


def shard_by_bytes(docs: DataFrame, shards: int = 8, plan: RangePlan = RangePlan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: in order of (text hash, id hash), shard k takes the records whose middle
    byte lies in the k-th of ``shards`` equal parts of all bytes.  Equal texts stay side by side; a
    group of them that a shard's end would part goes whole to the shard of its middle byte, unless
    it is larger than the plan's tolerance.  So shards differ from the mean by no more than the
    tolerance or one record, whichever is larger.  Size is the text's UTF-8 bytes plus 1; a null
    text has size 1 and, as an empty one, the crc32 of no bytes (0), and is of their group.
    Slots count from 0 inside a shard without gaps.  Null ids and repeated rows are records like
    others; an empty table gives no rows; other columns are neither read nor returned.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keys = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("text_hash"),
            F.xxhash64(F.col(doc_id), F.lit(17)).alias("id_hash"),
            F.monotonically_increasing_id().alias("row"),  # fixed by writing it
        ),
        "sharding-keys",
    )
    cuts, stats = _cut(keys, plan)
    total = sum(b for _, _, b in stats)
    rows_before = bytes_before = 0
    offsets = []
    for number, n, b in stats:
        offsets.append((number, rows_before, bytes_before))
        rows_before, bytes_before = rows_before + n, bytes_before + b
    spark = docs.sparkSession
    # one line for each range, so its size is bounded by the plan
    table = F.broadcast(spark.createDataFrame(offsets, "range int, rows_before long, bytes_before long"))
    order = Window.partitionBy("range").orderBy(*KEY)
    placed = written(
        keys.withColumn("range", _range_number(cuts).cast("int"))
        .withColumn("_nth", F.row_number().over(order) - 1)
        .withColumn("_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(table, "range")
        .select("doc_id", "size", "text_crc32", "text_hash", (F.col("rows_before") + F.col("_nth")).alias("_at"), (F.col("bytes_before") + F.col("_upto") - F.col("size")).alias("_from")),
        "sharding-places",
    )
    # twice the middle byte's place over twice all bytes, in whole numbers
    own = F.least(F.lit(shards - 1), F.expr(f"((2 * _from + size) * {shards}L) div {max(1, 2 * total)}L").cast("int"))
    for text_key, shard in _whole_groups(placed, shards, total, plan):
        own = F.when(F.col("text_hash") == text_key, F.lit(shard)).otherwise(own)
    placed = placed.withColumn("shard", own)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("_at").alias("_first")))  # a line for each shard
    return placed.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _whole_groups(placed: DataFrame, shards: int, total: int, plan: RangePlan) -> list[tuple[int, int]]:
    """(text hash, shard) of the groups of equal texts that shards' ends would part and needn't."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(max(1, shards - 1))), lambda k: k.cast("long") * total)
    parted = placed.where(F.exists(ends, lambda e: (F.col("_from") * shards <= e) & (e < (F.col("_from") + F.col("size")) * shards)))
    at = [r["text_hash"] for r in parted.select("text_hash").distinct().collect()]  # one for each end of a shard
    largest = placed.agg(F.max("size")).first()[0] or 0
    most = max(plan.tolerance * total / shards, largest)
    groups = placed.where(F.col("text_hash").isin(at)).groupBy("text_hash").agg(F.min("_from").alias("a"), F.max(F.col("_from") + F.col("size")).alias("b")).collect()
    return [(r["text_hash"], min(shards - 1, (r["a"] + r["b"]) * shards // (2 * total))) for r in groups if r["b"] - r["a"] <= most]
