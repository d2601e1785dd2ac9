"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte n-grams (1 to 4) of its lower-cased words, a space at each end of
a word; each has a small embedding by hash, a text is the mean of its subwords' embeddings, and
a linear softmax gives the language.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy.  As many texts again are set aside to fit the softmax's temperature and
the confidence below which a prediction is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, text_hash, unit_hash
from .words import WordTable, sums

BITS, GRAMS = 16, (1, 2, 3, 4)
#: A word character that is no decimal digit or underscore; most are letters.
_WORDLIKE = re.compile(r"[^\W\d_]")
NO_LANGUAGE = "und"


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script; marks and number signs are none."""
    return text is not None and any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all subwords of all words, and each word's number of them."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64)
    inner = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.r_[0, np.cumsum(inner + 1)[:-1]] if len(words) else np.zeros(0, dtype=np.int64)
    # word i with its spaces lies at start[i] .. start[i] + inner[i] + 1
    buckets, owners = [], []
    code = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        counts = np.maximum(inner + 2 - n + 1, 0)
        own = np.repeat(np.arange(len(words)), counts)
        at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start, counts)
        if n == 1:  # the spaces alone say nothing
            keep = data[at] != 32
            own, at = own[keep], at[keep]
        mixed = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(own)
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray | None = None  # logits of each bucket: embeddings times softmax weights
    bias: np.ndarray | None = None
    temperature: float = 1.0
    reject_below: float = 0.0

    def predict(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its calibrated probability."""
        z = (mean + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], aside: np.ndarray, dims: int = 12, epochs: int = 6, rate: float = 0.5, keep: float = 0.999, seed: int = 0) -> LanguageModel:
    """Trains on rows (buckets, counts) not set ``aside``; calibrates on the others.

    ``keep``: share of texts of the learned languages that rejection must leave.  The threshold is
    the confidence that the (1 - keep) * (n + 1)-th least sure of n rightly predicted texts has, so a
    text like them is rejected with a probability of 1 - keep at most.  Where n is too small for
    that, only what is less likely than not, and less sure than all of them, is rejected.
    """
    names = sorted(set(langs))
    if len(names) < 2:
        return LanguageModel(names)
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (1 << BITS, dims)), np.zeros((dims, len(names))), np.zeros(len(names))
    sq_e, sq_o, sq_b = np.full(1 << BITS, 1e-8), np.full(out.shape, 1e-8), np.full(len(names), 1e-8)
    rows = [(b, c / c.sum()) for b, c in rows]
    use = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(rows))
    out += rng.normal(0, 0.1, out.shape)
    for _ in range(epochs):
        for j in rng.permutation(use):
            bucket, weight = rows[j]
            x = weight @ emb[bucket]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[j]] -= 1
            g_x, g_o = out @ p, np.outer(x, p)
            sq_o += g_o * g_o
            sq_b += p * p
            out -= rate * g_o / np.sqrt(sq_o)
            bias -= 0.1 * rate * p / np.sqrt(sq_b)
            scale = weight * weight * (g_x @ g_x)
            sq_e[bucket] += scale
            emb[bucket] -= rate * (weight / np.sqrt(sq_e[bucket]))[:, None] * g_x[None, :]
    model = LanguageModel(names, (emb @ out).astype(np.float32), bias.astype(np.float32))
    held = np.flatnonzero(aside) if aside.any() else use
    mean = np.stack([rows[j][1] @ model.table[rows[j][0]] for j in held])

    def loss(t: float) -> float:
        z = (mean + model.bias) / t
        return float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(z)), y[held]]).mean())

    model.temperature = min(np.geomspace(0.2, 8, 40).tolist(), key=loss)
    best, p = model.predict(mean)
    right = np.sort(p[best == y[held]])
    if len(right):
        nth = int((1 - keep) * (len(right) + 1))
        model.reject_below = float(right[nth - 1] if nth else min(0.5, right[0]))
    return model


def train(docs: DataFrame, per_language: int = 500, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", seed: int = 5, most_languages: int = 1000) -> LanguageModel:
    """Learns from about ``per_language`` texts of each language and calibrates on as many others.

    The sample goes by a hash of the id, and the half of it by another.  Rows with null id, lang
    or text take no part, nor do texts without a word.  One text for each id and language (that
    of the least hash, if there are several) gives features, so repeated rows count once.  The
    counts of languages (more than ``most_languages`` are an error) and the sample's hashed
    features (at most 2^16 buckets a text) come to the driver, nothing else.
    """
    have = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("doc_id is not null and lang is not null")
    lines = have.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    counts = {r["lang"]: r["n"] for r in lines}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return LanguageModel([])
    shares = have.sparkSession.createDataFrame([(k, min(1.0, 2 * per_language / n)) for k, n in counts.items()], "lang string, share double")
    sample = have.join(F.broadcast(shares), "lang").where(unit_hash(F.col("doc_id"), seed) < F.col("share")).where("text is not null")
    sample = sample.groupBy("doc_id", "lang").agg(F.min_by("text", text_hash(F.col("text"))).alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            buckets, counts = [], []
            for t in batch["text"]:
                b, _ = subwords(t.lower().encode().split())
                found, n = np.unique(b, return_counts=True)
                buckets.append(found.astype(np.int32).tobytes())
                counts.append(n.astype(np.int32).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "aside": batch["aside"], "bucket": buckets, "n": counts})

    aside = unit_hash(F.col("doc_id"), seed + 1) < 0.5
    got = sample.select("doc_id", "lang", "text", aside.alias("aside")).mapInPandas(features, "doc_id long, lang string, aside boolean, bucket binary, n binary").toPandas()
    got = got[got["bucket"].map(len) > 0].sort_values(["doc_id", "lang"], kind="stable")
    # views of what came: the driver holds features once, next to their shares
    rows = [(np.frombuffer(b, dtype=np.int32), np.frombuffer(n, dtype=np.int32)) for b, n in zip(got["bucket"], got["n"], strict=True)]
    langs, aside = got["lang"].tolist(), got["aside"].to_numpy(dtype=bool)
    del got
    return fit(rows, langs, aside)


def language(text: Column, model: LanguageModel) -> Column:
    """struct<lang string, score double> of each whole text."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def rows(words: list[bytes]) -> np.ndarray:
            bucket, n = subwords(words)
            return np.concatenate([sums(model.table[bucket], n), n[:, None]], axis=1).astype(np.float32)

        table = None if model.table is None else WordTable(rows)
        names = np.array([*model.languages, NO_LANGUAGE], dtype=object)
        for batch in batches:
            texts = batch.tolist()
            letters = np.array([has_letter(t) for t in texts], dtype=bool)
            which, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            if table is None and model.languages:  # one language was learned
                which[letters], score[letters] = 0, 1.0
            elif table is not None:
                for begin, end, ids, lens in table.chunks([t if ok else None for t, ok in zip(texts, letters, strict=True)], lambda t: t.lower().encode()):
                    total = sums(table.values[ids], lens)
                    ok = letters[begin:end] & (lens > 0)
                    which[begin:end][ok], score[begin:end][ok] = model.predict(total[ok, :-1] / total[ok, -1:])
            yield pd.DataFrame({"lang": names[which], "score": np.clip(score, 0.0, 1.0)})

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, rejected.

    ``und`` with score 0 for a null text, one without a letter, or when no language was learned;
    these are rejected, as are predictions below the model's calibrated confidence.  Repeated
    rows stay, a null id stays null; other columns are neither read nor returned.
    """
    judged = docs.select(F.col(doc_id).alias("doc_id"), language(F.col(text), model).alias("_l"))
    return judged.select("doc_id", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"), ((F.col("_l.lang") == NO_LANGUAGE) | (F.col("_l.score") < model.reject_below)).alias("rejected"))


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``identify`` doesn't reject, with their columns, whatever their names.

    Each row is judged by its text alone, so repeated rows, ties and null ids change nothing; null
    texts and those without a letter go; an empty table gives no rows.
    """
    (found,) = free_names(docs, "_found")
    judged = docs.withColumn(found, language(F.col(text), model))
    return judged.where((F.col(found)["lang"] != NO_LANGUAGE) & (F.col(found)["score"] >= model.reject_below)).drop(found)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def predict_held_out(docs: DataFrame) -> DataFrame:
    """Learns from documents whose remainder is not 2 and predicts all."""
    learn_from = docs.select("doc_id", "lang", "text").where(remainder(F.col("doc_id")) != 2)
    found = identify(docs, train(learn_from))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
