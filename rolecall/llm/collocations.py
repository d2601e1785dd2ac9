"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word begins a suffix: itself and the words after it, within its piece, to the maximum depth.
A first pass finds the *hot* prefixes, which begin more than a fixed share of all suffixes; their
number is bounded, whatever the data.  The second adds up equal suffixes of a chunk of text and
routes them by their shortest prefix that isn't hot, so all suffixes that share it meet in one
bucket.  A bucket sorts pointers to its suffixes by three-way partitions at one word after the
other, to the maximum depth; the size of a partition of equal prefixes is the phrase's count, and
partitions below the least count are abandoned.  Hot prefixes, which lie in several buckets, are
counted by the chunks and added up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spans, written

#: A-Z get their lower case; bytes that end a piece become full stops, which no word holds; others stay.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
NO_LANGUAGE = "und"


@dataclass(frozen=True)
class PhraseParams:
    """Phrases of 2 to ``most_words`` words with a count of ``least`` or more; the ``top`` best of each
    language.  A phrase is dropped for a longer one that has ``inside`` percent of its count.  A
    prefix that begins more than 1 / ``hot`` of all suffixes (and ``fewest`` in each chunk) is hot, and
    at most 2 * ``hot`` of a length are; chunks of about ``chunk`` bytes are added up before the shuffle; a bucket holds about
    ``bucket`` suffixes, or those of one prefix that isn't hot.  Phrases are ranked in ``salts`` parts first."""

    most_words: int = 3
    least: int = 10
    inside: int = 50
    top: int = 2000
    hot: int = 8192
    fewest: int = 16
    chunk: int = 4_000_000
    bucket: int = 250_000
    salts: int = 16


class Chunk:
    """The suffixes of some texts: ``words`` (number 0 ends a piece), distinct ``suffixes`` as rows
    of word numbers, how many ``times`` each occurs, and the ``total``."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        tokens = b".".join(t.translate(_WORD_BYTES) for t in texts).replace(b".", b" . ").split()
        self.words = [b".", *set(tokens).difference((b".",))]
        self.number = dict(zip(self.words, range(len(self.words)), strict=True))
        ids = np.fromiter(map(self.number.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        del tokens
        starts = np.flatnonzero(ids)
        self.total = len(starts)
        self.suffixes, self.times = added_up(np.r_[ids, np.zeros(depth, dtype=np.int32)], starts, depth, len(self.words))

    def prefixes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct prefixes of exactly ``depth`` words and their counts; suffixes are sorted."""
        has = self.suffixes[:, depth - 1] > 0
        rows, times = self.suffixes[has, :depth], self.times[has]
        if not len(rows):
            return rows, times
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
        return rows[first], np.add.reduceat(times, first)

    def known(self, phrases: Iterable[bytes], depth: int) -> np.ndarray:
        """Word numbers [n, depth], sorted, of those of ``phrases`` that have ``depth`` words, all of which occur here."""
        split = (p.split(b" ") for p in phrases)
        rows = [[self.number[w] for w in words] for words in split if len(words) == depth and all(w in self.number for w in words)]
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, depth)

    def phrase(self, numbers: np.ndarray) -> bytes:
        return b" ".join([self.words[i] for i in numbers.tolist()])


def added_up(ids: np.ndarray, starts: np.ndarray, depth: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of ``depth`` numbers from each of ``starts`` (0 from where a piece ends), sorted, and how often each occurs.

    Suffixes whose numbers fit are packed into one integer each, which sorts faster.
    """
    bits = max(1, int(n_words).bit_length())
    packed = bits * depth <= 63
    column = ids[starts]
    code = column.astype(np.int64) if packed else [column]
    for k in range(1, depth):
        column = np.where(column > 0, ids[starts + k], 0)
        if packed:
            code <<= bits
            code |= column
        else:
            code.append(column)
    if not packed:
        rows, times = np.unique(np.stack(code, axis=1), axis=0, return_counts=True)
        return rows, times
    code.sort()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.r_[first, len(code)])
    code = code[first]
    out = np.empty((len(code), depth), dtype=np.int32)
    for k in range(depth):
        out[:, k] = (code >> (bits * (depth - 1 - k))) & ((1 << bits) - 1)
    return out, times


def sorted_counts(suffixes: np.ndarray, times: np.ndarray, least: int, whole_from: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth, phrases [n, depth] and the counts of all their prefixes [n, depth], the last their own.

    Multikey three-way quicksort over pointers, all partitions of a depth side by side: each is
    parted by its pivot's word into less, equal and greater.  The equal part is a phrase and goes one
    word deeper; parts whose ``times`` sum to less than ``least`` are abandoned.  Prefixes
    shorter than ``whole_from`` aren't all here: they are sorted, but neither counted nor abandoned.
    """
    pointers = np.arange(len(suffixes), dtype=np.int64)
    lens = np.full(min(1, len(suffixes)), len(suffixes), dtype=np.int64)
    before = np.zeros((len(lens), 0), dtype=np.int64)
    for depth in range(suffixes.shape[1]):
        word = suffixes[:, depth]
        limit = least if depth + 1 >= whole_from else 0
        equal: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(pointers):
            own = np.repeat(np.arange(len(lens)), lens)
            key = word[pointers]
            pivots = key[np.cumsum(lens) - lens + lens // 2]
            gap = key - pivots[own]
            unequal = []
            for side in (-1, 1, 0):
                mask = gap == 0 if side == 0 else gap < 0 if side < 0 else gap > 0
                part, owner = pointers[mask], own[mask]
                size = np.bincount(owner, minlength=len(lens))
                weight = np.bincount(owner, weights=times[part], minlength=len(lens)).astype(np.int64)
                live = (size > 0) & (weight >= limit)
                if side == 0:
                    live &= pivots > 0  # where a piece ended there is no longer phrase
                    equal.append((part[live[owner]], size[live], np.concatenate([before[live], weight[live, None]], axis=1)))
                else:
                    unequal.append((part[live[owner]], size[live], before[live]))
            pointers, lens, before = (np.concatenate(x) for x in zip(*unequal, strict=True))
        if not equal:
            return
        pointers, lens, before = (np.concatenate(x) for x in zip(*equal, strict=True))
        if depth + 1 >= whole_from:
            yield suffixes[pointers[np.cumsum(lens) - lens], : depth + 1], before


def _rows(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text")).where("text is not null")


def _chunks(batch: pd.DataFrame, depth: int, most: int) -> Iterator[tuple[str, Chunk]]:
    for name, part in batch.groupby("lang", sort=True):
        texts = part["text"].tolist()
        for begin, end in spans(list(map(len, texts)), most):
            yield name, Chunk([t.encode() for t in texts[begin:end]], depth)


def _often(rows: DataFrame, params: PhraseParams) -> tuple[int, DataFrame, dict[str, set[bytes]]]:
    """The number of all suffixes, that of each language (lang, n), and the hot prefixes of each.

    A chunk reports a prefix with 1 / (2 * hot) of its suffixes, and ``fewest`` of them at least.  Of a
    prefix with 1 / hot of all and ``fewest`` a chunk, at least 1 / (2 * hot) of all is reported, so it is
    found; no more than 2 * hot prefixes of a length can have that.
    """
    depth = max(1, params.most_words - 1)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, chunk in _chunks(batch, depth, params.chunk):
                found = [(name, 0, b"", chunk.total)]
                for k in range(1, depth + 1):
                    prefixes, times = chunk.prefixes(k)
                    often = times >= max(params.fewest, chunk.total / (2 * params.hot))
                    found += [(name, k, chunk.phrase(p), n) for p, n in zip(prefixes[often], times[often].tolist(), strict=True)]
                yield pd.DataFrame(found, columns=["lang", "depth", "phrase", "n"]).astype({"lang": object})

    reported = written(rows.mapInPandas(report, "lang string, depth int, phrase binary, n long").groupBy("lang", "depth", "phrase").agg(F.sum("n").alias("n")), "phrases-often")
    lines = reported.where("depth = 0").select("lang", "n")
    total = lines.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, set[bytes]] = {}
    for r in reported.where((F.col("depth") > 0) & (F.col("n") * 2 * params.hot >= total)).select("lang", "phrase").collect():
        hot.setdefault(r["lang"], set()).add(bytes(r["phrase"]))
    return total, lines, hot


def _routed(rows: DataFrame, hot: dict[str, set[bytes]], buckets: int, params: PhraseParams) -> DataFrame:
    """Packed suffixes of a chunk for each bucket, and (bucket -1) the chunk's counts of hot prefixes.

    lang, bucket, whole_from (words of the prefix they were routed by, or of the hot one), words, suffixes, times, n.
    """
    depth = params.most_words

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, chunk in _chunks(batch, depth, params.chunk):
                here, out = hot.get(name, set()), []
                code = np.fromiter((zlib.crc32(w) for w in chunk.words), dtype=np.uint64, count=len(chunk.words))
                place = np.full(len(chunk.suffixes), zlib.crc32(name.encode()), dtype=np.uint64)
                whole_from = np.full(len(chunk.suffixes), depth, dtype=np.int64)
                open_ = np.ones(len(chunk.suffixes), dtype=bool)
                for k in range(1, depth + 1):
                    place[open_] = (place[open_] + code[chunk.suffixes[open_, k - 1]]) * np.uint64(0x9E3779B97F4A7C15)
                    place[open_] ^= place[open_] >> np.uint64(29)
                    if k == depth:
                        break
                    # suffixes are sorted, so those of one prefix are a span
                    wanted = chunk.known(here, k)
                    low, high = _span(chunk.suffixes, wanted)
                    upto = np.r_[0, np.cumsum(chunk.times)]
                    out += [(name, -1, k, chunk.phrase(p), b"", b"", n) for p, n in zip(wanted, (upto[high] - upto[low]).tolist(), strict=True) if n]
                    edge = np.zeros(len(chunk.suffixes) + 1, dtype=np.int64)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, high, -1)
                    hot_here = np.cumsum(edge[:-1]) > 0
                    whole_from[open_ & ~hot_here] = k
                    open_ &= hot_here
                chunk.number = {}  # not needed any more
                bucket = (place % np.uint64(buckets)).astype(np.int64)
                group = bucket * (depth + 1) + whole_from
                order = np.argsort(group, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0, True]) if len(order) else []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    at = order[a:b]
                    used, numbers = np.unique(chunk.suffixes[at], return_inverse=True)
                    if used[0] > 0:  # number 0 is the end of a piece, whether it occurs or not
                        used, numbers = np.r_[0, used], numbers + 1
                    kind = np.uint16 if len(used) < 65536 else np.int32
                    out.append((name, int(bucket[at[0]]), int(whole_from[at[0]]), b" ".join([chunk.words[i] for i in used.tolist()]), numbers.astype(kind).tobytes(), _packed(chunk.times[at]), 0))
                yield pd.DataFrame(out, columns=["lang", "bucket", "whole_from", "words", "suffixes", "times", "n"]).astype({"lang": object})
                del chunk, out  # before the next one is made

    return rows.mapInPandas(route, "lang string, bucket long, whole_from int, words binary, suffixes binary, times binary, n long")


def _packed(times: np.ndarray) -> bytes:
    return times.astype(np.uint8 if times.max() < 256 else np.int64).tobytes()


def _span(rows: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 of the sorted rows that begin with each of the sorted ``prefixes``: halves all their ranges side by side, word by word."""
    low, high = np.zeros(len(prefixes), dtype=np.int64), np.full(len(prefixes), len(rows), dtype=np.int64)
    for k in range(prefixes.shape[1]):
        word, column = prefixes[:, k], rows[:, k]
        ends = []
        for least in (word, word + 1):
            a, b = low.copy(), high.copy()
            while (open_ := np.flatnonzero(a < b)).size:
                middle = (a[open_] + b[open_]) // 2
                before = column[middle] < least[open_]
                a[open_[before]] = middle[before] + 1
                b[open_[~before]] = middle[~before]
            ends.append(a)
        low, high = ends
    return low, high


def _frequent(suffixes: np.ndarray, times: np.ndarray, column: int, least: int) -> np.ndarray:
    """Whether a suffix has a word at ``column`` that all suffixes have there ``least`` times: others are in no frequent phrase as long."""
    word = suffixes[:, column]
    return (word > 0) & (np.bincount(word, weights=times)[word] >= least) if len(word) else np.zeros(0, dtype=bool)


_COUNTED = "lang string, phrase string, size int, a long, lefts array<long>"


def _counted(routed: DataFrame, params: PhraseParams) -> DataFrame:
    """lang, phrase, size, a, lefts (counts of the phrase's prefixes, null for hot ones) of all that occur often but the hot prefixes."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (name, whole_from), part in group.groupby(["lang", "whole_from"], sort=True):
            number: dict[bytes, int] = {b".": 0}
            suffixes, times = [], []
            for words, packed, n in zip(part["words"], part["suffixes"], part["times"], strict=True):
                listed = words.split(b" ")
                new = [w for w in listed if w not in number]
                number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                ids = np.fromiter(map(number.__getitem__, listed), dtype=np.int32, count=len(listed))
                suffixes.append(ids[np.frombuffer(packed, dtype=np.uint16 if len(listed) < 65536 else np.int32)].reshape(-1, params.most_words))
                times.append(np.frombuffer(n, dtype=np.uint8 if len(n) == len(suffixes[-1]) else np.int64).astype(np.int64))
            listed = list(number)
            rows, often = np.concatenate(suffixes), np.concatenate(times)
            del number, suffixes, times
            wanted = _frequent(rows, often, int(whole_from) - 1, params.least)
            rows, often = rows[wanted], often[wanted]
            for phrases, counts in sorted_counts(rows, often, params.least, int(whole_from)):
                size = phrases.shape[1]
                text = [b" ".join([listed[i] for i in p]).decode() for p in phrases.tolist()]
                lefts = [[None if k < whole_from - 1 else int(c) for k, c in enumerate(row)] for row in counts[:, :-1].tolist()]
                out.append(pd.DataFrame({"lang": name, "phrase": text, "size": size, "a": counts[:, -1], "lefts": pd.Series(lefts, dtype=object)}))
        return pd.concat(out).astype({"lang": object}) if out else pd.DataFrame(columns=["lang", "phrase", "size", "a", "lefts"], dtype=object)

    return routed.where("bucket >= 0").groupBy("bucket").applyInPandas(count, _COUNTED)


def top_phrases(docs: DataFrame, params: PhraseParams = PhraseParams(), lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of each language.

    Cutting a phrase after k words gives l and r, the counts of both parts, and the score
    floor(1000000 * a * a / (l * r)); the lowest-scoring cut counts, the first of equals.  Ordered by
    score and a, both descending, then by phrase in byte order.  Null and empty texts hold no words;
    a null lang is ``und``, together with rows that say so; repeated rows count as often as they
    occur, and ids are not read.  Empty tables, and languages without a phrase that occurs often
    enough, give no rows; other columns are neither read nor returned.  Scores are exact for counts
    up to 10^15.
    """
    rows = _rows(docs, lang, text)
    total, totals, hot = _often(rows, params)
    buckets = max(1, math.ceil(total / params.bucket))
    routed = written(_routed(rows, hot, buckets, params), "phrases-routed")
    counted = written(_counted(routed, params), "phrases-counted")
    often = written(routed.where("bucket < 0").groupBy("lang", F.col("words").cast("string").alias("phrase"), F.col("whole_from").alias("size")).agg(F.sum("n").alias("a")).where(F.col("a") >= params.least), "phrases-hot")
    # of a phrase that occurs ``least`` times both parts do, so their counts are here
    hot_left = often.select(F.col("lang"), F.col("phrase").alias("first"), F.col("a").alias("_l"))
    hot_right = often.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("a").alias("_r"))
    phrases = counted.where("size > 1").unionByName(often.where("size > 1").withColumn("lefts", F.lit(None).cast("array<long>")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(F.broadcast(hot_left), ["lang", "first"], "left").join(F.broadcast(hot_right), ["lang", "rest"], "left").withColumn("l", F.coalesce(F.get("lefts", F.col("k") - 1), "_l")).drop("lefts", "_l")
    right = counted.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = written(cuts, "phrases-cuts")
    cuts = cuts.where("_r is null").drop("_r").join(right, ["lang", "rest"]).unionByName(cuts.where("_r is not null").withColumnRenamed("_r", "r"))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("_top", F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a")).withColumn("_low", whole("l") * whole("r")).withColumn("score", F.expr("_top div _low"))
    # a phrase inside a longer one is, by the same count or a larger one, inside one that is longer by a word
    judged = F.struct("score", "k", "a", "l", "r")
    none = F.lit(None).cast("struct<score:bigint,k:int,a:bigint,l:bigint,r:bigint>")
    line = lambda phrase, what: F.struct(F.col(phrase).alias("phrase"), what.alias("cut"))
    gone = lambda part, count, k: F.when((F.col("size") > 2) & (F.col("k") == k) & (100 * F.col("a") >= params.inside * F.col(count)), line(part, none))
    lines = cuts.select("lang", F.explode(F.array_compact(F.array(line("phrase", judged), gone("first", "l", F.col("size") - 1), gone("rest", "r", F.lit(1))))).alias("_x")).select("lang", "_x.phrase", "_x.cut")
    kept = lines.groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.bool_or(F.col("cut").isNull()).alias("_gone")).where(~F.col("_gone")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(params.salts))).orderBy(*by))).where(F.col("rank") <= params.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= params.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    return r"""
with pieces as (select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
 occurrences as (select lang, 1 as size, unnest(w) as phrase from pieces
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from pieces
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from pieces),
 f as (select lang, size, phrase, count(*) as a from occurrences group by all),
 totals as (select lang, sum(a)::bigint as n from f where size = 1 group by lang),
 often as (select * from f where a >= 10),
 cuts as (select lang, size, phrase, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, size)) as k from often where size > 1)),
 scored as (select c.lang, c.phrase, c.size, c.a, c.k, x.a as l, y.a as r, (1000000::hugeint * c.a * c.a // (x.a::hugeint * y.a))::bigint as score
  from cuts c join often x on x.lang = c.lang and x.phrase = c.first join often y on y.lang = c.lang and y.phrase = c.rest),
 lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 inner_parts as (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from (select *, string_split(phrase, ' ') as w from often where size = 3)),
 dropped as (select distinct o.lang, o.phrase from inner_parts i join often o on o.lang = i.lang and o.phrase = i.phrase where 100 * i.a >= 50 * o.a),
 ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest anti join dropped using (lang, phrase))
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000"""
