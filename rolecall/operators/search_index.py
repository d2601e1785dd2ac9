"""Substring search by a table of trigrams, instead of a scan of every text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .listing import like


def trigrams(c: Column) -> Column:
    """The different runs of three characters of a text in lower case; none for null and shorter ones."""
    text = F.lower(F.coalesce(c, F.lit("")))
    places = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(3))))


def grams_of(part: str) -> list[str]:
    """Trigrams that a match of ``part`` holds for sure: those of its runs between wildcards, ASCII only."""
    runs = re.split(r"[%_\\]", part.lower())
    return sorted({g for run in runs for g in (run[i : i + 3] for i in range(len(run) - 2)) if g.isascii()})


class TrigramIndex:
    """(gram, text) of all different texts and (text, key) of all rows, written once in ranges (``ranges`` at most) and sorted by them.

    Rows share texts, so a text's grams are found and stored once, however many rows have it.  A text's
    number is its hash, of the first seed under which no two texts have the same.  A search reads the
    lines of its two rarest grams (a part of one file each, by the statistics of the file), tests the
    texts that have both, and gives the rows of those that fit.  Parts without three characters in
    a row between wildcards are tested on all different texts.  Rows are parted by ``key``, which is unique.
    """

    #: Up to so many texts that fit, their rows are looked up by the statistics of the files; of more, all files are read.
    LISTED = 1000
    #: A range has about so many lines.
    LINES = 100_000

    def __init__(self, rows: DataFrame, key: str, columns: Sequence[str], ranges: int = 200, number: Callable[[Column, Column], Column] = F.xxhash64) -> None:
        self.rows, self.key, self.columns = rows, key, list(columns)
        texts = rows.select(F.explode(F.array(*columns)).alias("text")).where("text is not null").distinct()
        texts = written(texts, "texts")
        n = texts.count()
        seed = next(s for s in count() if texts.select(number(F.col("text"), F.lit(s)).alias("n")).distinct().count() == n)
        of = lambda c: F.when(c.isNotNull(), number(c, F.lit(seed)))
        self.texts = texts.withColumn("number", of(F.col("text")))
        # for ``explode`` the optimizer would add a filter that makes the grams a second time
        lines = self.texts.select(F.explode_outer(trigrams(F.col("text"))).alias("gram"), "number").where("gram is not null")
        self.lines = self._sorted(written(lines, "grams"), "gram", "number", ranges, "trigrams")
        numbered = rows.select(F.explode(F.array(*[of(F.col(c)) for c in columns])).alias("number"), F.col(key).alias("key")).where("number is not null")
        self.held = self._sorted(written(numbered, "numbered"), "number", "key", ranges, "texts-of-rows")

    def _sorted(self, lines: DataFrame, first: str, second: str, ranges: int, name: str) -> DataFrame:
        """``lines``, a written table, written in order; ranges are cut by a sample, so it is read twice."""
        parts = min(ranges, lines.count() // self.LINES + 1)
        return written(lines.repartitionByRange(parts, first, second).sortWithinPartitions(first, second), name)

    def keys(self, part: str) -> DataFrame:
        """The keys of the rows of which a column holds ``part`` (case-blind; % and _ are wildcards)."""
        fits = self.texts.where(like(F.col("text"), part))
        if grams := grams_of(part):
            counts = {g: 0 for g in grams} | {r["gram"]: r["count"] for r in self.lines.where(F.col("gram").isin(grams)).groupBy("gram").count().collect()}
            wanted = sorted(grams, key=lambda g: (counts[g], g))[:2]
            found = [self.lines.where(F.col("gram") == g).select("number") for g in wanted]
            fits = fits.join(reduce(lambda a, b: a.join(b, "number", "left_semi"), found), "number", "left_semi")
        some = [r["number"] for r in fits.select("number").limit(self.LISTED + 1).collect()]
        held = self.held if len(some) > self.LISTED else self.held.where(F.col("number").isin(some) if some else F.lit(False))
        return held.join(fits.select("number"), "number", "left_semi").select(F.col("key").alias(self.key)).distinct()  # two columns of a row may fit

    def find(self, part: str) -> DataFrame:
        """The rows of which a column holds ``part``."""
        return self.rows.join(self.keys(part), self.key, "left_semi")
