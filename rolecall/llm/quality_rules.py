"""Quality rules with suffix-array repetition.

The words of a batch of texts are numbered and a suffix array of all of them is made by prefix
doubling, texts kept apart.  The longest common prefix of neighbours in the array gives, for each
position, the deepest LCP interval it lies in, hence the longest substring that begins there and
occurs again in the same text.  Those that no longer one covers from the left are the maximal
repeated substrings; their spans are united, and limits on the covered fraction and on the
longest repeat give the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WordTable

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionLimits:
    """A repeat counts from ``least_words`` words; a text fails beyond either of the limits.

    ``most_covered`` bounds the fraction of words inside repeats.  ``most_longest`` bounds the
    longest repeat as a fraction of the text, for repeats of more than ``free_words`` words.
    """

    least_words: int = 8
    most_covered: float = 0.3
    most_longest: float = 0.05
    free_words: int = 50


def longest_repeats(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that begins there and recurs in its text."""
    total = len(ids)
    if not total:
        return np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(lens)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(total)  # words from here to the text's end
    # a rank is the number of suffixes that come before in what has been compared so far
    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.empty(total, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(total), 0))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=total)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        after = np.where(left[open_] > width, rank[np.minimum(open_ + width, total - 1)] + 1, 0)
        order = np.lexsort((after, rank[open_]))
        at, nxt = open_[order], after[order]
        old = rank[at]
        place = np.arange(len(at))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        part = np.maximum.accumulate(np.where(np.r_[True, (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])], place, 0))
        rank = rank.copy()
        rank[at] = old + part - group
        width *= 2
        levels.append(rank.astype(np.int32))
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(total - 1, 0), dtype=np.int64)
    pair = np.flatnonzero(doc[a] == doc[b])
    a, b = a[pair], b[pair]
    common = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (left[a] - common > 0) & (left[b] - common > 0)
        i, j = np.minimum(a + common, total - 1), np.minimum(b + common, total - 1)
        common += np.where(ok & (levels[k][i] == levels[k][j]), 1 << k, 0)
    lcp[pair] = common
    out = np.zeros(total, dtype=np.int64)
    out[order] = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    return out


def maximal_spans(longest: np.ndarray, lens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the maximal repeated substrings of ``least`` words or more."""
    first = np.zeros(len(longest), dtype=bool)
    first[(np.cumsum(lens) - lens)[lens > 0]] = True
    before = np.r_[0, longest[:-1]]
    begin = np.flatnonzero((longest >= least) & (first | (before <= longest)))
    return begin, longest[begin]


def covered(begin: np.ndarray, length: np.ndarray, total: int) -> np.ndarray:
    """Which positions lie in one of the spans."""
    edge = np.bincount(begin, minlength=total + 1) - np.bincount(begin + length, minlength=total + 1)
    return np.cumsum(edge)[:total] > 0


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, spans array<struct<begin:int,end:int>>"


def measures(text: Column, limits: RepetitionLimits, spans: bool = False) -> Column:
    """The measures of each whole text; ``spans`` adds the united spans of its repeats, in words."""

    @F.pandas_udf(_COLUMNS)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = WordTable(lambda words: np.zeros((len(words), 1), dtype=np.int8))
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch]
            out = np.zeros((len(texts), 7), dtype=np.int64)
            lists: list[list[dict] | None] = [[] if spans else None for _ in texts]
            for i, (t, data) in enumerate(zip(batch, texts, strict=True)):
                if data:
                    out[i, 1] = len(t) - len(data) + len(data.translate(None, SPACE))
                    out[i, 2] = len(data) - len(data.translate(None, SYMBOLS))
                    if b"\n" in data:
                        lines = [x for x in data.split(b"\n") if x.strip()]
                        out[i, 3] = len(lines) - len(set(lines))
            for begin, end, ids, lens in table.chunks(texts):
                doc = np.repeat(np.arange(end - begin), lens)
                longest = longest_repeats(ids, lens)
                five = np.flatnonzero(longest >= 5)
                part = out[begin:end]
                part[:, 0] = lens
                part[:, 4] = np.bincount(doc[covered(five, np.full(len(five), 5), len(ids))], minlength=end - begin)
                at, length = maximal_spans(longest, lens, limits.least_words)
                inside = covered(at, length, len(ids))
                part[:, 5] = np.bincount(doc[inside], minlength=end - begin)
                np.maximum.at(part[:, 6], doc[at], length)
                if spans and len(ids):
                    first = np.cumsum(lens) - lens
                    opens = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | (doc[1:] != doc[:-1])])
                    closes = np.flatnonzero(inside & np.r_[~inside[1:] | (doc[1:] != doc[:-1]), True]) + 1
                    for o, c in zip(opens, closes, strict=True):
                        lists[begin + doc[o]].append({"begin": int(o - first[doc[o]]), "end": int(c - first[doc[o]])})
            frame = pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"])
            frame["spans"] = pd.Series(lists, dtype=object)
            yield frame

    return measure(text)


def repeated_spans(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each united span of repeats: doc_id, begin, end (in words, end excluded).

    A text without repeats, null or empty ones among them, has no row; repeated rows have their
    spans each, a null id stays null, an empty table gives no rows; other columns are not read.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), measures(F.col(text), limits, spans=True).alias("_m"))
    return found.select("doc_id", F.explode("_m.spans").alias("_s")).select("doc_id", "_s.begin", "_s.end")


def judge(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its measures, base_failed, and kept.

    Words are runs of characters other than ASCII white space; a null text has none.  The base
    rule fails a text of under 10 words, or with more than 20 % of its words in 5-word windows
    that occur twice or more.  ``kept`` is false then, or if the repeats exceed ``limits``.
    Repeated rows stay, a null id stays null, an empty table gives no rows; other columns are
    neither read nor returned.
    """
    m = docs.select(F.col(doc_id).alias("doc_id"), measures(F.col(text), limits).alias("_m")).select("doc_id", "_m.*").drop("spans")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    too_long = (F.col("longest_repeat") > limits.free_words) & (F.col("longest_repeat") > limits.most_longest * F.col("n_words"))
    repeats = (F.col("covered_words") > limits.most_covered * F.col("n_words")) | too_long
    return m.withColumn("base_failed", base).withColumn("kept", ~(base | repeats))
