"""Collocations against a plain version with Python's own integers."""

import collections
import re

import numpy as np
import pandas as pd
import pytest

from rolecall.llm import collocations
from rolecall.llm.collocations import PhraseParams, sorted_counts


def plain(rows, most_words=3, least=10, inside=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most_words + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        gone = set()
        for p, a in often.items():
            for size in range(2, len(p)):
                gone |= {p[i : i + size] for i in range(len(p) - size + 1) if 100 * a >= inside * counts[p[i : i + size]]}
        lines = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                lines.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(lines)[:top])]
    return sorted(out)


def run(spark, rows, **params):
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "'x' as rank", "map(1, 2) as n", "null as bucket")
    got = collocations.top_phrases(docs, PhraseParams(**params))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(map(tuple, got.collect()))


def made(seed, n=400):
    rng = np.random.default_rng(seed)
    words = ["a", "The", "of", "café", "É", "x\x1cy", "\x00", "b", "c", "dd", "e-e", "'f"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; ", "?!"]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for _ in range(n):
        k = int(rng.integers(0, 60))
        text = "".join(str(w) + str(m) for w, m in zip(rng.choice(words, k, p=weights / weights.sum()), rng.choice(marks, k), strict=True))
        rows.append(([None, "en", "und", "fr"][int(rng.integers(0, 4))], text))
    return [*rows, ("en", None), ("en", ""), ("xx", None), (None, " . , "), ("de", "nur zwei"), ("de", "nur zwei"), ("en", "one two " * 20_000), *[("en", "hot pair here")] * 300]


@pytest.mark.parametrize("params", [{}, {"hot": 4, "fewest": 1, "chunk": 500, "bucket": 200}, {"hot": 40, "fewest": 3, "bucket": 50, "top": 7, "salts": 3}, {"most_words": 5, "least": 4, "hot": 10, "fewest": 1, "bucket": 300}, {"most_words": 2, "least": 2, "inside": 80}])
def test_equals_a_plain_version(spark, params):
    rows = made(1)
    assert run(spark, rows, **params) == plain(rows, **{k: v for k, v in params.items() if k in ("most_words", "least", "inside", "top")})


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()]
    assert run(spark, rows, hot=200, fewest=2, chunk=100_000, bucket=20_000) == plain(rows)


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [("en", None)]) == [] and run(spark, [("en", "few words")]) == []


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(5)
    suffixes = np.minimum(rng.zipf(1.4, (3000, 4)), 40).astype(np.int32)
    suffixes[np.cumsum(rng.random(suffixes.shape) < 0.1, axis=1) > 0] = 0
    suffixes = suffixes[suffixes[:, 0] > 0]
    times = rng.integers(1, 5, len(suffixes))
    want = collections.Counter()
    for row, t in zip(suffixes.tolist(), times.tolist(), strict=True):
        for k in range(1, 5):
            if row[k - 1] > 0:
                want[tuple(row[:k])] += t
    for whole_from in (1, 2, 3):
        got = {}
        for phrases, counts in sorted_counts(suffixes, times, 7, whole_from):
            for p, c in zip(phrases.tolist(), counts.tolist(), strict=True):
                assert c == [want[tuple(p[: k + 1])] for k in range(len(p))]
                got[tuple(p)] = c[-1]
        assert got == {p: n for p, n in want.items() if n >= 7 and len(p) >= whole_from}


def test_wide_numbers_are_added_up():
    ids = np.array([3, 1, 2, 3, 1, 2, 0, 3, 1, 0, 0, 0, 0, 0, 0], dtype=np.int32)
    starts = np.flatnonzero(ids)
    few, many = collocations.added_up(ids, starts, 3, 4), collocations.added_up(ids, starts, 3, 1 << 22)
    assert np.array_equal(few[0], many[0]) and np.array_equal(few[1], many[1]) and few[1].sum() == len(starts)


def test_hot_prefixes_are_found_by_numbers(monkeypatch):
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 9, (2000, 3)).astype(np.int32), axis=0)
    for depth in (1, 2):
        prefixes = np.array(sorted({tuple(r) for r in rng.integers(0, 12, (60, depth)).tolist()}))
        low, high = collocations._span(rows, prefixes)
        for p, a, b in zip(prefixes, low.tolist(), high.tolist(), strict=True):
            assert np.array_equal(np.flatnonzero((rows[:, :depth] == p).all(axis=1)), np.arange(a, b))
    # a chunk spells out the hot prefixes that it has, not every prefix
    spelt = []
    monkeypatch.setattr(collocations.Chunk, "phrase", lambda chunk, numbers: spelt.append(tuple(numbers)) or b" ".join(chunk.words[i] for i in numbers.tolist()))
    docs = pd.DataFrame({"lang": "en", "text": [" ".join(f"w{i} v{i} the end" for i in range(3000))]})

    class Rows:
        def mapInPandas(self, route, schema):
            return pd.concat(list(route(iter([docs]))))

    routed = collocations._routed(Rows(), {"en": {b"the", b"the end", b"not here", b"nowhere"}}, 5, PhraseParams())
    assert len(spelt) == 2 and {(r.words, r.n) for r in routed.itertuples() if r.bucket < 0} == {(b"the", 3000), (b"the end", 3000)}


def test_suffixes_of_rare_words_are_not_sorted():
    suffixes = np.array([[1, 2, 3], [1, 4, 0], [5, 2, 3], [1, 2, 0], [6, 0, 0]], dtype=np.int32)
    times = np.array([4, 3, 2, 4, 9])
    assert collocations._frequent(suffixes, times, 0, 9).tolist() == [True, True, False, True, True]
    assert collocations._frequent(suffixes, times, 1, 8).tolist() == [True, False, True, True, False]
    assert collocations._frequent(suffixes[:0], times[:0], 0, 1).tolist() == []
