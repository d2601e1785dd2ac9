"""Quality classifier and language identification: held-out accuracy and edge cases."""

import numpy as np
import pytest

from rolecall.llm import language_id, quality_classifier
from rolecall.llm.words import WordTable

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_accuracy_on_held_out(tables):
    docs, _ = tables
    got = language_id.predict_held_out(docs).toPandas()
    assert len(got) == docs.count()
    truth = docs.select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert 150 < len(held) < 350
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert both[both.rejected].shape[0] < 0.02 * len(both)


def test_language_needs_letters(spark, tables):
    docs, _ = tables
    model = language_id.train(docs, per_language=50)
    rows = [(1, None), (2, ""), (3, " 12 34 ½ _ !"), (4, "the and of this that"), (None, "the and of this that"), (4, "the and of this that"), (6, "日本"), (7, "the and " * 60000)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang_pred"), model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0 and by[3].rejected
    assert by[4].lang_pred == by[None].lang_pred == by[7].lang_pred == "en"
    assert by[6].lang_pred in model.languages
    assert language_id.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.train(docs)
    other = ["Tämä on suomenkielinen lause joka kertoo metsästä ja järvestä", "これは日本語の文章です", "xqz wvk jjq zzkx vvbq qqxz", "Это предложение о погоде", "Bu cümle hava hakkında bilgi verir"]
    got = language_id.identify(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), model)
    assert all(r.rejected for r in got.collect())
    # texts of the learned languages that were not in the sample stay, but for the share that the threshold gives up
    seen = language_id.identify(docs, model).join(docs.where("lang is not null").select("doc_id"), "doc_id", "left_semi").toPandas()
    assert seen.rejected.mean() < 0.006


def test_predictions_equal_a_plain_version(spark, tables):
    docs, _ = tables
    model = language_id.train(docs, per_language=30)
    some = docs.where("text is not null").orderBy("doc_id").limit(25).toPandas()
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(some[["doc_id", "text"]]), model).collect()}
    for doc_id, text in zip(some.doc_id, some.text, strict=True):
        total, n = np.zeros(len(model.languages)), 0
        for word in text.lower().encode().split():
            padded = b" " + word + b" "
            for size in (1, 2, 3, 4):
                for at in range(len(padded) - size + 1):
                    gram = padded[at : at + size]
                    if gram == b" ":
                        continue
                    code = 0
                    for byte in gram:
                        code = (code * 257 + byte + 1) % 2**64
                    total += model.table[((code + size) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language_id.BITS)]
                    n += 1
        z = np.exp((total / n + model.bias) / model.temperature)
        assert got[doc_id].lang_pred == model.languages[int(z.argmax())]
        assert got[doc_id].score == pytest.approx(z.max() / z.sum(), abs=1e-4)


def test_language_fit_equals_plain_steps():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 40, 6)), None) for _ in range(24)]
    rows = [(b, rng.integers(1, 4, len(b)).astype(float)) for b, _ in rows]
    langs = ["a" if b.min() < 5 else "b" for b, _ in rows]
    model = language_id.fit(rows, langs, np.zeros(24, dtype=bool), dims=3, epochs=2, seed=6)
    r = np.random.default_rng(6)
    emb, out, bias = r.normal(0, 0.1, (1 << language_id.BITS, 3)), np.zeros((3, 2)), np.zeros(2)
    out += r.normal(0, 0.1, out.shape)
    sq_e, sq_o, sq_b = {}, np.full((3, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(2):
        for j in r.permutation(24):
            bucket, n = rows[j]
            share = n / n.sum()
            x = sum(w * emb[b] for b, w in zip(bucket, share, strict=True))
            p = np.exp(x @ out + bias)
            p = p / p.sum() - np.eye(2)[sorted(set(langs)).index(langs[j])]
            g_x, g_o = out @ p, np.outer(x, p)
            sq_o, sq_b = sq_o + g_o**2, sq_b + p**2
            out, bias = out - 0.5 * g_o / np.sqrt(sq_o), bias - 0.05 * p / np.sqrt(sq_b)
            for b, w in zip(bucket.tolist(), share, strict=True):
                sq_e[b] = sq_e.get(b, 1e-8) + w * w * (g_x @ g_x)
                emb[b] = emb[b] - 0.5 * w * g_x / np.sqrt(sq_e[b])
    assert model.table == pytest.approx(emb @ out, abs=1e-4) and model.bias == pytest.approx(bias, abs=1e-5)


def test_repeated_rows_of_a_language_count_once(spark):
    rows = [(i, "xx" if i % 2 else "yy", f"{'aa bb' if i % 2 else 'cc dd'} {i}") for i in range(60)]
    docs, again = (spark.createDataFrame(r, "doc_id long, lang string, text string") for r in (rows, rows + rows[:5] * 40))
    a, b = language_id.train(docs), language_id.train(again)
    assert np.array_equal(a.table, b.table) and a.reject_below == b.reject_below
    with pytest.raises(ValueError):
        language_id.train(docs, most_languages=1)


def test_stages_keep_columns_of_any_name(spark, tables):
    docs, labels = tables
    clash = docs.selectExpr("*", "doc_id as _found", "doc_id as _row", "doc_id as _grade", "doc_id as _text").unionAll(docs.limit(3).selectExpr("*", "1", "1", "1", "1"))
    for out in (language_id.keep_known(clash, language_id.train(docs)), quality_classifier.keep_good(clash, quality_classifier.train(docs, quality_classifier.quality_grades(labels), 3), 2)):
        assert out.columns == clash.columns and 0 < out.count() <= clash.count()
        assert out.limit(0).count() == 0


def test_language_learns_from_nothing_or_one(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert language_id.train(empty).languages == []
    some = spark.createDataFrame([(1, "aa bb")], "doc_id long, text string")
    assert language_id.identify(some, language_id.train(empty)).collect()[0].lang_pred == "und"
    one = spark.createDataFrame([(i, "xx", "aa bb") for i in range(20)], "doc_id long, lang string, text string")
    assert language_id.identify(some, language_id.train(one)).collect()[0].lang_pred == "xx"


def test_subwords_stay_in_their_word():
    bucket, n = language_id.subwords([b"ab", b"c", b"ab"])
    assert n.tolist() == [2 + 3 + 2 + 1, 1 + 2 + 1, 2 + 3 + 2 + 1]
    assert bucket[:8].tolist() == bucket[-8:].tolist()
    alone, _ = language_id.subwords([b"c"])
    assert sorted(bucket[8:12].tolist()) == sorted(alone.tolist())


def test_quality_on_ratings_not_learned_from(tables):
    docs, labels = tables
    grades = quality_classifier.quality_grades(labels).cache()
    model = quality_classifier.train(docs, grades.where("doc_id % 3 <> 0"), n_grades=3)
    got = quality_classifier.classify(docs, model, tail_from=2).toPandas().merge(grades.where("doc_id % 3 = 0").toPandas(), on="doc_id")
    good, bad = got[got.grade == 2], got[got.grade == 1]
    assert good.kept.mean() > 0.9
    assert bad.kept.mean() < 0.6  # some 60 bad ratings to learn from
    assert got[got.grade == 2].expected_grade.mean() > got[got.grade == 1].expected_grade.mean() > 0


def test_scores_equal_brute_force(spark, tables):
    docs, labels = tables
    model = quality_classifier.train(docs, quality_classifier.quality_grades(labels), n_grades=3, most=150)
    some = docs.orderBy("doc_id").limit(40).toPandas()
    got = {r.doc_id: r for r in quality_classifier.classify(spark.createDataFrame(some[["doc_id", "text"]]), model, tail_from=2).collect()}
    for doc_id, text in zip(some.doc_id, some.text, strict=True):
        words = text.encode().split()
        kinds = set(words)
        b = quality_classifier.word_buckets(words)
        score = sum(model.weights[quality_classifier.word_buckets([w])[0, :3]].sum() for w in kinds) / len(kinds) ** 0.5
        score += sum(model.weights[quality_classifier.PRESENT + quality_classifier.word_buckets([w])[0, 0]] for w in kinds)
        score += model.weights[b[:, 3]].mean() + model.weights[quality_classifier.REPEAT] * sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words)
        tail = 1 / (1 + np.exp(model.thresholds[1] - score))
        assert got[doc_id].tail_probability == pytest.approx(tail, abs=1e-4)
    bucket, value = next(quality_classifier.sparse_features([some.text[0].encode()], WordTable(quality_classifier.word_buckets)))
    assert float(model.weights[bucket] @ value) == pytest.approx(float(model.thresholds[1] - np.log(1 / got[some.doc_id[0]].tail_probability - 1)), abs=1e-3)


def test_quality_edges(spark, tables):
    docs, labels = tables
    model = quality_classifier.train(docs, quality_classifier.quality_grades(labels), n_grades=3)
    rows = [(1, None, 1.0), (2, " ", 1.0), (None, "the and of", 1.0), (3, "the and of " * 50000, 1.0), (3, "the and of", 1.0)]
    got = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string, kept double"), model, tail_from=2).collect()
    assert len(got) == 5
    assert all(r.expected_grade is None and r.tail_probability is None and not r.kept for r in got if r.doc_id in (1, 2))
    none = quality_classifier.train(docs, spark.createDataFrame([], "doc_id long, grade int"), n_grades=3)
    kept = {(r.doc_id, r.kept) for r in quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string, kept double"), none, tail_from=2).collect()}
    assert kept == {(1, False), (2, False), (None, True), (3, True)}


def test_common_words_take_the_short_way_to_the_same_buckets():
    words = ["Hello", "ABC", "A", "idiot!", "end.", "x,", "été", "don't", "(a)", "12", "a1", "--", "über;", "Q?", "?", "NATO:"]
    got = quality_classifier.word_buckets([w.encode() for w in words])
    slow = quality_classifier.word_buckets([("\u200b" + w).encode() for w in words])  # an edge that is stripped
    assert (got[:, :3] == slow[:, :3]).all()
    shapes = {w: b for w, b in zip(words, got[:, 3].tolist(), strict=True)}
    assert shapes["ABC"] != shapes["Hello"] == shapes["A"] == shapes["été"] and shapes["end."] != shapes["x,"]
    assert shapes["über;"] == quality_classifier.word_buckets([b"uber;"])[0, 3]


def test_repeated_rows_teach_once(spark, tables):
    rows = [(1, "good words here")] * 500 + [(1, "other words")] + [(2, "bad words here")] * 500 + [(i, f"good text {i}") for i in range(10, 30)] + [(i, f"bad text {i}") for i in range(30, 50)]
    ratings = [(1, 2), (1, 2), (2, 0), *((i, 2) for i in range(10, 30)), *((i, 0) for i in range(30, 50)), (None, 1), (99, None)]
    docs, graded = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, grade int")
    once = spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string")
    a, b = quality_classifier.train(docs, graded, 3), quality_classifier.train(once.repartition(3), graded, 3)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_fit_equals_plain_steps():
    # the same likelihood, its gradient by differences, in plain loops over dense vectors
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 1, 2], dtype=np.int32), rng.normal(size=3).astype(np.float32)) for _ in range(30)]
    grades = np.array([int(v[0] + v[1] > -0.5) + int(v[0] > 0.5) for _, v in rows])
    model = quality_classifier.fit(list(rows), grades, 3, epochs=2, seed=4)
    w, theta = np.zeros(3), np.log((share := np.array([(grades <= k).mean() for k in range(2)])) / (1 - share))
    squares, squares_t, order = np.full(3, 1e-6), np.ones(2), np.random.default_rng(4)

    def loss(w, theta, x, y):
        low = 0.0 if y == 0 else 1 / (1 + np.exp(w @ x - theta[y - 1]))
        up = 1.0 if y == 2 else 1 / (1 + np.exp(w @ x - theta[y]))
        return -np.log(up - low)

    for _ in range(2):
        for j in order.permutation(30):
            x, y, h = rows[j][1].astype(float), grades[j], 1e-6
            g = np.array([(loss(w + h * e, theta, x, y) - loss(w - h * e, theta, x, y)) / (2 * h) for e in np.eye(3)]) + 1e-3 * w
            t = np.array([(loss(w, theta + h * e, x, y) - loss(w, theta - h * e, x, y)) / (2 * h) for e in np.eye(2)])
            squares += g * g
            w = w - 0.3 * g / np.sqrt(squares)
            squares_t += t * t
            theta = np.sort(theta - 0.3 * t / np.sqrt(squares_t))
    assert model.weights[:3] == pytest.approx(w, abs=1e-3) and model.thresholds == pytest.approx(theta, abs=1e-3)


def test_worst_of_repeated_labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, None), (4, None, 1), (None, 1, 0)]
    got = {r.doc_id: r.grade for r in quality_classifier.quality_grades(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: 1, 2: 0, 3: None, 4: 0, None: 2}


def test_words_are_worked_out_in_slices_and_texts_encoded_by_chunks():
    asked, encoded = [], []

    def rows(words):
        asked.append(len(words))
        return np.array([[len(w)] for w in words])

    def encode(t):
        encoded.append(t)
        return t.encode()

    texts = [" ".join(f"w{k}" for k in range(30_000)), None, "", "é w1", "x " * 600_000]
    table = WordTable(rows)
    chunks = table.chunks(texts, encode)
    begin, end, ids, lens = next(chunks)
    assert (begin, end) == (0, 4) and max(asked) <= 8_192 and sum(asked) == 30_001 and texts[4] not in encoded
    assert table.values[ids, 0].tolist() == [len(f"w{k}") for k in range(30_000)] + [2, 2]
    begin, end, ids, lens = next(chunks)
    assert (begin, end) == (4, 5) and lens.tolist() == [600_000]
    assert next(WordTable(rows).chunks([b"a bb"]))[3].tolist() == [2]
