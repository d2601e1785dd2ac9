"""The attention model against a plain version, and the word model against plain counts."""

import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle

from rolecall.llm import lm_scoring
from rolecall.llm.attention import AttentionModel, CorpusCounts, Pass
from rolecall.llm.bpe import vocabulary
from rolecall.llm.common import small_batches
from rolecall.llm.lm_scoring import END, Lexicon, LmParams, Subwords, WordTree, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def plain_base(rows):
    learn = [plain_words(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(w for ws in learn for w in ws)
    n, v = counts.total(), len(counts)
    out = []
    for i, t in rows:
        ws = plain_words(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)))
    return sorted(out, key=repr)


ROWS = [(i, f"Some Words w{i % 7} of text {i % 3} are here, again\tand \x1c again {'café' if i % 2 else 'É'}") for i in range(200)]
ROWS += [(200, None), (201, ""), (None, "a null id"), (None, None), (5, ROWS[5][1]), (202, " \t\n"), (203, "x" * 3000), (204, "long text " * 5000), (205, "<|endoftext|> 日本語 \xa0 　"), (206, "unseen0 words0")]


@pytest.mark.parametrize("params", [LmParams(), LmParams(known=10, pairs=20, fit_tokens=500, remembered=5, stride=4)])
def test_words_equal_plain_counts(spark, params):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as word", "'x' as n", "map(1, 2) as score", "3 as held_out", "5 as _row")
    got = lm_scoring.score_held_out(docs.repartition(3), PATH, params)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in rows), key=repr) == plain_base(ROWS)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id, r.n_tokens].add(round(r.score, 3))
    assert len(by[5, rows[0].n_tokens]) <= 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score_held_out(empty, PATH).count() == 0
    only = spark.createDataFrame([(None, "no learning")], "doc_id long, text string")
    (row,) = lm_scoring.score_held_out(only, PATH).collect()
    assert row.train_tokens == 0 and row.base_score == 0 and row.n_known == 0 and row.score < 0


def test_better_than_single_words_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scoring.score_held_out(docs, PATH).where("held_out").toPandas()
    assert 60 < len(got) < 140 and got.score.sum() > got.base_score.sum()
    assert plain_base([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.fixture(scope="module")
def small():
    subwords = Subwords(vocabulary(PATH))
    texts = [words_of(t) for _, t in ROWS[:60]] + [words_of(None)]
    flat = [w for ws in texts for w in ws]
    tokens, sizes = subwords.of(flat)
    tokens, first, width = tokens.astype(np.int64), np.cumsum(sizes) - sizes, subwords.end + 1
    inside = np.ones(len(tokens), dtype=bool)
    inside[first] = False
    keys, pairs = np.unique(np.r_[0, tokens[:-1]][inside] * width + tokens[inside], return_counts=True)
    keys, pairs = keys[::2], pairs[::2]  # the others aren't kept
    count = lambda at: np.bincount(tokens[at], minlength=width)
    counts = CorpusCounts(subwords.starts, count(slice(None)), count(first), count(np.r_[first[1:], len(tokens)] - 1), keys, pairs)
    words = collections.Counter(w for ws in texts for w in ws)
    known = sorted(words)[: len(words) // 2]
    tree = WordTree(subwords, known, np.array([words[w] for w in known], dtype=float))
    model = AttentionModel(counts, subwords.end, 6, 4, 4)
    sample = Lexicon(subwords, counts, tree, less=1)
    lens = np.array(list(map(len, texts)))
    model.fit(*sample.sequences(sample.numbers(texts), lens), epochs=3)
    return subwords, counts, tree, model


def plain_distribution(subwords, counts, tree, model, tokens):
    """Probabilities of all ids as the next one, from the ids before, without windows in batches."""
    size, stride = len(counts.total), model.stride
    inputs = [subwords.end, *tokens]
    i = len(inputs) - 1
    seen = range(max(0, (i // stride - 1) * stride), i + 1)
    score = np.array([np.clip(model.q[inputs[i]] @ model.k[inputs[j]] / model.dims**0.5, -40, 40) + model.near[i - j] for j in seen])
    weight = np.exp(score) / np.exp(score).sum()
    hidden = weight @ model.v[[inputs[j] for j in seen]] + model.own[inputs[i]]
    gates = np.exp(hidden @ model.out + model.bias)
    gates /= gates.sum()
    x = np.full(size, inputs[i])
    ids = np.arange(size)
    pair = np.where(subwords.starts, 1.0 if not tokens else counts.word_end(x), counts.pair(x, ids)).astype(np.float32)
    # the word's tokens so far, and what known words do after them
    at = max((k for k, t in enumerate(tokens) if subwords.starts[t]), default=None)
    part = list(tokens[at:]) if at is not None else []
    if not part:
        word = np.where(subwords.starts, 1.0, 0.0)
    else:
        codes = lm_scoring._prefix_codes(np.array([part + [y] for y in ids]).ravel(), np.full(size, len(part) + 1)).reshape(size, -1)
        at = tree.places.find(codes[:1, -2])[0]
        here, ends = tree.passing[at], tree.ending[at]
        word = np.where(subwords.starts, ends, tree.passing[tree.places.find(codes[:, -1])]) / here if here else np.full(size, -1.0)
    return gates @ model._choices(x, ids, pair, word.astype(np.float32)).T


@pytest.mark.parametrize("text", ["some words of", "some words unseen0 again", "", "w1 w2 of text 1 are here, again and café are"])
def test_scores_are_those_of_a_distribution(small, text):
    subwords, counts, tree, model = small
    lexicon = Lexicon(subwords, counts, tree)
    words = words_of(text)
    tokens, sizes, pair, word = lexicon.sequences(lexicon.numbers([words, words[:-1] or [END]]), np.array([len(words), len(words[:-1] or [END])]))
    logs = model.log10(tokens, sizes, pair, word)
    for i in range(sizes[0]):
        p = plain_distribution(subwords, counts, tree, model, tokens[:i].tolist())
        assert abs(p.sum() - 1) < 1e-3
        assert abs(math.log10(p[tokens[i]]) - logs[i]) < 1e-3
    # a second text in the batch doesn't see the first, nor a token those after it
    assert np.allclose(logs[: sizes[0] - 1], logs[sizes[0] : sizes[0] + sizes[0] - 1], atol=1e-4) or not text


def test_attention_learns_from_all_texts(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 204], "doc_id long, text string").repartition(3)
    params = LmParams(fit_tokens=1)  # the beginning has no text, or few
    model = lm_scoring.train(docs, PATH, params)
    fresh = AttentionModel(model.attention.counts, model.attention.end, params.dims, params.experts, params.stride, params.seed)
    # all ids that are followed by another in any text: those but the end, which nothing follows, and it, which begins texts
    met = np.flatnonzero(model.attention.counts.total > 0)
    for name in ("own", "q", "k", "v"):
        moved = np.abs(getattr(model.attention, name) - getattr(fresh, name)).max(axis=1) > 0
        assert moved[met].mean() > 0.99 and not np.delete(moved, met).any()
    assert (model.attention.emit != fresh.emit).any() and not model.attention.squares


def test_a_pass_follows_the_slope(small):
    """A step's direction is that of differences of the texts' logarithms, for each table."""
    subwords, counts, tree, model = small
    lexicon = Lexicon(subwords, counts, tree, less=1)
    texts = [words_of(t) for _, t in ROWS[:2]]
    given = lexicon.sequences(lexicon.numbers(texts), np.array(list(map(len, texts))))
    emit, squares = model.emit, model.squares
    try:
        model.squares = {n: np.full(getattr(model, n).shape, 1e12, dtype=np.float32) for n in (*Pass.TABLES, *Pass.DENSE)}
        one = Pass(model, rate=1e6)  # a step is the slope itself
        grown = one.held / one.held.sum(axis=0)
        model.emit, model.made = grown.astype(np.float32), None
        one.learn(*given)
        token = int(given[0][0])
        for name in (*Pass.TABLES, *Pass.DENSE):
            table = getattr(model, name)
            i = Pass.TABLES.index(name) if name in Pass.TABLES else None
            step = one.table[:, i * model.dims : (i + 1) * model.dims] - table if i is not None else one.dense[name] - table
            at = (token, 2) if i is not None else tuple(np.unravel_index(np.abs(step).argmax(), step.shape))
            kept, logs = table[at], []
            for move in (0.02, -0.02):
                table[at], model.made = kept + np.float32(move), None
                logs.append(float(np.sum(model.log10(*given), dtype=np.float64)) * math.log(10))
            table[at] = kept
            slope = (logs[0] - logs[1]) / 0.04
            assert abs(slope - step[at]) < 0.05 * abs(slope) + 0.02, name
    finally:
        model.emit, model.squares, model.made = emit, squares, None


def test_workers_get_small_batches(spark, monkeypatch):
    """Whatever is run for the model or the scores deals rows in batches bounded in bytes, and the session is left as it was."""
    name, seen, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", [], []
    before, written = spark.conf.get(name), lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df, what: seen.append((what, int(spark.conf.get(name).rstrip("b")))) or written(df, what))
    docs = spark.createDataFrame([(i, f"text {i} " * 400) for i in range(2000)], "doc_id long, text string").coalesce(1)
    assert lm_scoring.score_held_out(docs, PATH, LmParams(fit_tokens=500)).count() == 2000
    assert [what for what, _ in seen] == ["lm-words", "lm-pairs", "lm-learned", "lm-scored"] and all(most <= 4_000_000 for _, most in seen)
    assert spark.conf.get(name) == before
    with small_batches(spark, 1_000_000):
        sizes = docs.select("text").mapInPandas(lambda batches: (b.assign(text=str(b["text"].str.len().sum())) for b in batches), "text string").distinct().collect()
    assert len(sizes) > 1 and all(int(r["text"]) < 1_500_000 for r in sizes)


def test_a_pass_gives_its_rows_range_by_range(small):
    subwords, counts, tree, model = small
    one = Pass(model)
    lexicon = Lexicon(subwords, counts, tree, less=1)
    texts = [words_of(t) for _, t in ROWS[:20]]
    one.learn(*lexicon.sequences(lexicon.numbers(texts), np.array(list(map(len, texts)))))
    tracemalloc.start()
    try:
        given = {number: [len(x) // 8 for x in data] for number, *data in one.rows()}
        assert tracemalloc.get_traced_memory()[1] < 3_000_000
    finally:
        tracemalloc.stop()
    assert sum(n for number, (n, _, _) in given.items() if number >= 0) == len(counts.total)
    assert all(change == n * 4 * model.dims and seen == n * 4 for number, (n, change, seen) in given.items() if number >= 0)


def test_numbers_of_words_as_met(small):
    subwords, counts, tree, _ = small
    lexicon = Lexicon(subwords, counts, tree)
    lexicon.fix([b"some", b"words"])
    assert lexicon.numbers([[b"new", b"words"], [b"new", b"other", b"some"]]).tolist() == [2, 1, 2, 3, 0]
    lexicon.forget(1)
    assert lexicon.numbers([[b"other", b"words", b"other"]]).tolist() == [2, 1, 2] and lexicon.listed == [b"some", b"words", b"other"]
    assert lexicon.numbers([]).tolist() == []


def test_functions_do_not_hold_the_model(spark, monkeypatch):
    """Else workers hold it a second time, pickled."""
    docs = spark.createDataFrame(ROWS[:50], "doc_id long, text string").repartition(3)
    sizes, kind = [], type(docs)
    given = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, *a, **b: sizes.append(len(cloudpickle.dumps(f))) or given(self, f, *a, **b))
    assert lm_scoring.score_held_out(docs, PATH, LmParams(fit_tokens=50)).count() == 50
    assert len(sizes) == 4 and max(sizes) < 1_000_000
