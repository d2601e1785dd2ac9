"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - score), with one weight for each hashed text feature
shared by all thresholds.  Features of a text are its distinct words' cores and their first four
and five characters, each word scaled by 1 / sqrt(distinct words), the shapes of its words by
frequency, the share of words equal to the word before, and, unscaled by the text's length, the
presence of cores that tell grades apart, so that an insult counts as much in a long text.
Training runs in numpy on the driver over a bounded sample of rated texts, whose features Spark
computes; scoring runs over whole texts where they lie, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_hash, unit_hash
from .words import WordTable, sums

BITS = 18
MASK = (1 << BITS) - 1
REPEAT = 1 << BITS
#: The first bucket of presences, and all buckets.
PRESENT, WIDTH = REPEAT + 1, REPEAT + 1 + (1 << BITS)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_ENDS = {b"", b".", b",", b";", b":", b"!", b"?"}
_SAME = re.compile(r"(.)\1+", re.DOTALL)


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Four feature buckets for each word: core, its first four and five characters, shape."""
    out = np.zeros((len(words), 4), dtype=np.int32)
    for i, word in enumerate(words):
        end = b"" if word[-1:].isalpha() else word[-1:]
        if end in _ENDS and (letters := word[: len(word) - len(end)]).isalpha():  # ASCII letters, as most words are
            core, shape = letters.lower(), (b"A" if len(letters) > 1 and letters.isupper() else b"a") + end
            out[i] = zlib.crc32(core) & MASK, zlib.crc32(b"\1" + core[:4]) & MASK, zlib.crc32(b"\2" + core[:5]) & MASK, zlib.crc32(b"\0" + shape) & MASK
            continue
        text = word.decode("utf-8", "replace")
        core = _EDGES.sub("", text).lower()
        shape = _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", text)
        shape = _SAME.sub(r"\1", _DIGITS.sub("0", shape))[:4]
        out[i] = (
            zlib.crc32(core.encode()) & MASK,
            zlib.crc32(b"\1" + core[:4].encode()) & MASK,
            zlib.crc32(b"\2" + core[:5].encode()) & MASK,
            zlib.crc32(b"\0" + shape.encode()) & MASK,
        )
    return out


def _distinct(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word numbers of each text, in order of the texts, and how many each has."""
    width = int(ids.max()) + 1 if len(ids) else 1
    pairs = np.unique(doc * width + ids)
    return pairs % width, np.bincount(pairs // width, minlength=n_docs)


def _repeats(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    same = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]) if len(ids) else np.zeros(0, dtype=bool)
    return np.bincount(doc[1:][same], minlength=n_docs)


def sparse_features(texts: list[bytes | None], table: WordTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text; both are empty for a text without words."""
    for begin, end, ids, lens in table.chunks(texts):
        n = end - begin
        doc = np.repeat(np.arange(n), lens)
        once, kinds = _distinct(ids, doc, n)
        repeats = _repeats(ids, doc, n)
        at_word, at_kind = np.r_[0, np.cumsum(lens)], np.r_[0, np.cumsum(kinds)]
        for i in range(n):
            if not lens[i]:
                yield np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
                continue
            words = table.values[once[at_kind[i] : at_kind[i + 1]]]
            lexical = words[:, :3].ravel()
            shapes = table.values[ids[at_word[i] : at_word[i + 1]], 3]
            bucket = np.concatenate([lexical, shapes, [REPEAT], PRESENT + words[:, 0]])
            value = np.concatenate([np.full(len(lexical), kinds[i] ** -0.5), np.full(len(shapes), 1 / lens[i]), [repeats[i] / lens[i]], np.ones(len(words))])
            found, where = np.unique(bucket, return_inverse=True)
            yield found.astype(np.int32), np.bincount(where, value).astype(np.float32)


@dataclass
class OrdinalModel:
    """Weights by bucket and ordered thresholds; None thresholds mean that nothing was learned."""

    weights: np.ndarray
    thresholds: np.ndarray | None

    def grade(self, scores: np.ndarray, tail_from: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of ``tail_from`` or more, of each score."""
        above = 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])
        return above.sum(axis=1), above[:, tail_from - 1]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, epochs: int = 6, rate: float = 0.3, l2: float = 1e-3, seen: int = 8, telling: float = 5.0, seed: int = 0) -> OrdinalModel:
    """Fits by AdaGrad over shuffled examples, and shortens ``rows`` in place.

    Buckets seen in fewer than ``seen`` texts get no weight, nor do presences in texts whose mean
    grade is within ``telling`` standard errors of that of all.
    """
    weights = np.zeros(WIDTH)
    present = np.unique(grades)
    if len(present) < 2:
        return OrdinalModel(weights.astype(np.float32), None)
    times, total = np.zeros(WIDTH, dtype=np.int32), np.zeros(WIDTH)
    for (bucket, _), grade in zip(rows, grades, strict=True):
        times[bucket] += 1
        total[bucket] += grade
    usual = times >= min(seen, max(1, len(rows) // 20))
    gap = np.abs(total - times * grades.mean()) / (grades.std() * np.sqrt(np.maximum(times, 1)))
    usual[PRESENT:] &= gap[PRESENT:] >= telling
    for j, (bucket, value) in enumerate(rows):
        rows[j] = bucket[usual[bucket]], value[usual[bucket]]
    share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    squares, squares_t = np.full(WIDTH, 1e-6), np.ones(n_grades - 1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for j in rng.permutation(len(rows)):
            bucket, value = rows[j]
            y, score = grades[j], float(weights[bucket] @ value)
            up = _sigmoid(theta[y] - score) if y < n_grades - 1 else 1.0
            low = _sigmoid(theta[y - 1] - score) if y > 0 else 0.0
            p = max(up - low, 1e-9)
            d_up, d_low = up * (1 - up), low * (1 - low)
            g = (d_up - d_low) / p * value + l2 * weights[bucket]
            squares[bucket] += g * g
            weights[bucket] -= rate * g / np.sqrt(squares[bucket])
            for k, d in ((y, -d_up / p), (y - 1, d_low / p)):
                if 0 <= k < n_grades - 1:
                    squares_t[k] += d * d
                    theta[k] -= rate * d / np.sqrt(squares_t[k])
            theta.sort()
    return OrdinalModel(weights.astype(np.float32), theta)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, most: int = 6000, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> OrdinalModel:
    """Learns from at most ``most`` rated texts (those with the least seeded hash of their id).

    ``ratings`` has doc_id and grade (0 to n_grades - 1); of an id rated more than once the least
    grade counts, and null ids and grades don't.  The sample is bounded by ``most`` rows, so it
    may be broadcast.  One text for each id (that of the least hash, where an id comes with
    several) gives features, so at most ``most`` lines come to the driver.  Ids without a text,
    and texts that are null or without a word, teach nothing.
    """
    worst = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = worst.orderBy(unit_hash(F.col("doc_id"), seed), "doc_id").limit(most)
    rated = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id")
    rated = rated.groupBy("doc_id", "grade").agg(F.min_by("text", text_hash(F.col("text"))).alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(word_buckets)
        for batch in batches:
            made = list(sparse_features([t.encode() for t in batch["text"]], table))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": batch["grade"], "bucket": [b.tobytes() for b, _ in made], "value": [v.tobytes() for _, v in made]})

    # packed, so that the driver holds 8 bytes a feature
    got = rated.mapInPandas(features, "doc_id long, grade int, bucket binary, value binary").toPandas()
    got = got[got["bucket"].map(len) > 0].sort_values("doc_id", kind="stable")
    rows = [(np.frombuffer(b, dtype=np.int32), np.frombuffer(v, dtype=np.float32)) for b, v in zip(got["bucket"], got["value"], strict=True)]
    grade = got["grade"].to_numpy(dtype=np.int64)
    del got
    return fit(rows, grade, n_grades)


def grades(text: Column, model: OrdinalModel, tail_from: int) -> Column:
    """struct<expected double, tail double>; both null for a null text or one without words."""
    if model.thresholds is None:
        return F.lit(None).cast("struct<expected:double,tail:double>")

    @F.pandas_udf("expected double, tail double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def rows(words: list[bytes]) -> np.ndarray:
            b = word_buckets(words)
            return np.stack([model.weights[b[:, :3]].sum(axis=1), model.weights[b[:, 3]], model.weights[PRESENT + b[:, 0]]], axis=1)

        table = WordTable(rows)
        for batch in batches:
            texts = batch.tolist()
            found = np.full((len(texts), 2), np.nan)
            for begin, end, ids, lens in table.chunks(texts, str.encode):
                n = end - begin
                doc = np.repeat(np.arange(n), lens)
                once, kinds = _distinct(ids, doc, n)
                full = lens > 0
                score = sums(table.values[once, 0], kinds) / np.sqrt(np.maximum(kinds, 1)) + sums(table.values[once, 2], kinds)
                score += (sums(table.values[ids, 1], lens) + _repeats(ids, doc, n) * model.weights[REPEAT]) / np.maximum(lens, 1)
                found[begin:end][full] = np.stack(model.grade(score[full], tail_from), axis=1)
            out = pd.DataFrame(found, columns=["expected", "tail"]).astype("Float64")
            yield out.mask(np.isnan(found))

    return score(text)


def classify(docs: DataFrame, model: OrdinalModel, tail_from: int, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail_probability, kept.

    ``kept`` says that the probability of grade ``tail_from`` or more is at least ``least``.  A
    null text, or one without words, has null grade and probability and is not kept.  A model
    that learned nothing (no ratings, or all alike) grades nothing and keeps every text with a
    word.  Repeated rows stay, a null id stays null; other columns are not read or returned.
    """
    judged = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).withColumn("_grade", grades(F.col("_text"), model, tail_from))
    kept = F.coalesce(F.col("_grade.tail") >= least, F.lit(False)) if model.thresholds is not None else F.coalesce(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return judged.select("doc_id", F.col("_grade.expected").alias("expected_grade"), F.col("_grade.tail").alias("tail_probability"), kept.alias("kept"))


def keep_good(docs: DataFrame, model: OrdinalModel, tail_from: int, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns, whatever their names.

    Each row is judged by its text alone, so repeated rows, ties and null ids change nothing; null
    texts and those without a word go; an empty table gives no rows.
    """
    if model.thresholds is None:
        return docs.where(F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return docs.where(grades(F.col(text), model, tail_from)["tail"] >= least)


def quality_grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade from labels: 0 toxic, 1 low quality, 2 good; the worst of repeated labels.

    A null quality or toxic says nothing; where both are unsaid, or quality is unsaid of a text that
    isn't toxic, the grade is null.  A null id is one id; an empty table gives no rows.
    """
    return labels.groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t")).select("doc_id", F.when(F.col("_t") == 1, 0).when(F.col("_q") == 0, 1).when(F.col("_q") == 1, 2).alias("grade"))
