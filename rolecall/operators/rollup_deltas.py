"""Stored rollups kept up to date by signed deltas, instead of being counted afresh.

A batch gives the rows that it changed, as they were (none for new ones) and as they are (none for
deleted ones).  Old rows count -1, new ones +1, so the work follows the batch, not the table.  A
maximum can't be taken back that way; it is kept as counts of its values, of which the
largest that still occurs is the maximum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listing import VERDICTS


def company_counters() -> dict[str, Column]:
    """What a posting (with its verdict) adds to its company's rollup."""
    active = F.col("status") == "ACTIVE"
    return {"active": active, **{v.lower(): active & (F.col("verdict") == v) for v in VERDICTS}, "unverified": F.col("verification") == "UNVERIFIED"}


def deltas(before: DataFrame, after: DataFrame, keys: Sequence[str], counters: Mapping[str, Column]) -> DataFrame:
    """keys and the change of each counter; keys without any change are left out."""

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*keys, *[F.when(c, sign).otherwise(0).cast("long").alias(n) for n, c in counters.items()])

    change = signed(before, -1).unionAll(signed(after, 1)).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counters])
    moved = F.lit(False)
    for n in counters:
        moved = moved | (F.col(n) != 0)
    return change.where(moved)


def applied(stored: DataFrame, change: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next stored counters; keys that are new in ``change`` begin at 0."""
    names = [c for c in stored.columns if c not in keys]
    return stored.unionByName(change).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def value_deltas(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, ``value`` and n: how many rows more (or fewer) have the value; nulls don't count."""
    held = [rows.where(F.col(value).isNotNull()) for rows in (before, after)]
    return deltas(*held, [*keys, value], {"n": F.lit(True)})


def largest(stored: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The maximum of ``value`` of each key out of the stored counts of values; a key whose rows are all gone has none."""
    return stored.where("n > 0").groupBy(*keys).agg(F.max(value).alias(value))
