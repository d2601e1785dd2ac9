"""Each stage against its operator's own verdicts and a plain version, and on edge cases."""

import hashlib
import math
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from rolecall.llm import language_id, mixing, ngram_join, quality_classifier
from rolecall.llm.common import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in cp.STAGES:
        docs.append(written(stage(spark, docs[-1], DATA), name))
    return docs


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "mix", "tokens"]
    assert all(d.dtypes == stages[0].dtypes for d in stages[1:-1])


def test_quality_and_language_drop_what_is_rejected(spark, stages):
    ratings = quality_classifier.quality_grades(spark.read.parquet(f"{DATA}/labels.parquet"))
    model = quality_classifier.train(stages[0], ratings, n_grades=3)
    assert ids(stages[1]) == ids(quality_classifier.classify(stages[0], model, 2).where("kept"))
    assert 0 < stages[1].count() < stages[0].count()
    found = language_id.identify(stages[1], language_id.train(stages[1]))
    assert ids(stages[2]) == ids(found.where("not rejected"))


def test_one_of_each_group(stages):
    left = Counter(r.class_id for r in ngram_join.near_duplicates(stages[2]).select("class_id").collect())
    assert ids(stages[3]) == Counter(left.keys())
    assert ngram_join.near_duplicates(stages[3]).where("n_links > 0").count() == 0


def test_mix_and_tokens(stages):
    want = {r.doc_id: r.times for r in mixing.mix_by_source(stages[3]).collect() if r.times}
    assert ids(stages[4]) == Counter(want)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(want)
    for r in got:
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and len(r.ids) == 4 * r.n_tokens


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, cp.run(spark, DATA).drop("ids").collect())) == sorted(map(tuple, stages[5].drop("ids").collect()))


def plain_quality(model, text):
    words = (text or "").encode().split()
    if not words:
        return False
    kinds = {w: quality_classifier.word_buckets([w])[0] for w in set(words)}
    score = sum(float(model.weights[b[:3]].sum()) / len(kinds) ** 0.5 + float(model.weights[quality_classifier.PRESENT + b[0]]) for b in kinds.values())
    score += sum(float(model.weights[kinds[w][3]]) for w in words) / len(words)
    score += float(model.weights[quality_classifier.REPEAT]) * sum(a == b for a, b in pairwise(words)) / len(words)
    return 1 / (1 + math.exp(model.thresholds[1] - score)) >= 0.5


def plain_language(model, text):
    total, n = np.zeros(len(model.languages)), 0
    if not any(c.isalpha() for c in text or ""):
        return False
    for word in text.lower().encode().split():
        bucket, _ = language_id.subwords([word])
        total += model.table[bucket].sum(axis=0, dtype=np.float64)
        n += len(bucket)
    z = (total / n + model.bias) / model.temperature
    return float(np.exp(z.max() - z.max()) / np.exp(z - z.max()).sum()) >= model.reject_below


def plain_groups(rows):
    """The least id of each row's group, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = text.encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    least = [i for i, _ in rows]
    changed = True
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    return least


def test_first_stages_equal_plain_versions(spark, stages):
    ratings = quality_classifier.quality_grades(spark.read.parquet(f"{DATA}/labels.parquet"))
    good, lang = quality_classifier.train(stages[0], ratings, n_grades=3), language_id.train(stages[1])
    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    rows = [r for r in rows if plain_quality(good, r[1])]
    assert {i for i, _ in rows} == set(ids(stages[1]))
    rows = [r for r in rows if plain_language(lang, r[1])]
    assert {i for i, _ in rows} == set(ids(stages[2]))
    assert set(plain_groups(rows)) == set(ids(stages[3]))


WORDS = "the quick brown fox jumps over a lazy dog near some old river bank where children play every warm day".split()
CLASH = ["_found", "_row", "_times", "_copy", "_maybe", "_bucket", "_at", "_bits", "_grade", "size", "unit", "key", "tag", "pattern", "n", "set_key", "times"]


@pytest.fixture(scope="module")
def edges(spark):
    """Null and empty texts, null ids, repeats, an id with two texts, a text in two sources, odd columns."""
    text = lambda k: " ".join(WORDS[(k * 7 + j) % len(WORDS)] for j in range(18)) + f" item {k}"
    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, None, "en", "s0"), (101, "", "en", "s0"), (102, " \n ", None, None), (103, "12 34 !", "en", "s1"), (None, text(3), "en", "s1"), (None, None, None, None), (None, text(50), None, "s2")]
    rows += [(7, text(7), "en", "s1")] * 3 + [(8, " ".join(f"other{j} and" for j in range(12)), "en", "s2"), (9, text(9), "en", "s9"), (40, text(5), "en", None), (41, "x " * 40_000, "en", "s0")]
    made = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    return made.selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(i, int(i % 4 != 0), int(i % 7 == 0)) for i in range(30)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_edge_cases_of_each_stage(spark, edges, labelled, name):
    stage = dict(cp.STAGES)[name]
    got = stage(spark, edges, labelled)
    rows, given = [tuple(r) for r in got.collect()], [tuple(r) for r in edges.collect()]
    if name == "tokens":
        assert Counter(r[0] for r in rows) == Counter(r[0] for r in given)
        assert all(r.n_tokens == 0 and r.ids == b"" for r in got.where("doc_id in (100, 101)").collect())
    else:
        assert got.dtypes == edges.dtypes and set(rows) <= set(given)
    if name == "quality":
        assert not {100, 101, 102} & {r[0] for r in rows}
        assert all(rows.count(r) == given.count(r) for r in rows)
    if name == "language":
        assert not {100, 101, 102, 103} & {r[0] for r in rows} and None in {r[0] for r in rows}
        assert all(rows.count(r) == given.count(r) for r in rows)
    if name == "near_duplicates":
        assert rows.count(next(r for r in given if r[0] == 7)) == 1
        # id 9 has one text in two sources, of which one row stays; id 8 has two texts, and both stay
        assert [sum(r[0] == i for r in rows) for i in (8, 9)] == [2, 1] and 40 not in {r[0] for r in rows}
        assert sum(r[0] is None for r in rows) == 3 and {100, 101, 102} <= {r[0] for r in rows}
    if name == "mix":
        assert not {100, 101, 102} & {r[0] for r in rows} and len(rows) >= 20
        again = stage(spark, edges.orderBy("n_chars").repartition(3), labelled)
        assert Counter(rows) == Counter(tuple(r) for r in again.collect())
    empty = stage(spark, edges.limit(0), labelled)
    assert empty.count() == 0 and empty.columns == got.columns


def test_nothing_is_left_in_the_shared_folder_after_clear(spark):
    import os

    from rolecall.llm.common import clear, shared_dir

    assert written(spark.range(3), "x").count() == 3 and os.listdir(shared_dir(spark))
    clear(spark)
    assert not os.path.exists(shared_dir(spark))
