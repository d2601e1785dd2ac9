import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rolecall.llm import quality_rules as qr

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_longest(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            if j != i:
                k = 0
                while i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=5))
def test_suffix_array(docs):
    ids = np.array([x for d in docs for x in d], dtype=np.int64)
    got = qr.longest_repeats(ids, np.array([len(d) for d in docs], dtype=np.int64)).tolist()
    assert got == [x for d in docs for x in brute_longest(d)]


def brute(text, limits):
    t = text or ""
    words = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(5)}
    longest = brute_longest(words)
    inside = {i + k for i, n in enumerate(longest) if n >= limits.least_words for k in range(n)}
    top = max([n for n in longest if n >= limits.least_words], default=0)
    base = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    bad = len(inside) > limits.most_covered * len(words) or (top > limits.free_words and top > limits.most_longest * len(words))
    row = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), len(inside), top, base, not base and not bad)
    spans = []
    for i in sorted(inside):
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    return row, [tuple(s) for s in spans]


def test_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = sorted(texts, key=len)[:120]
    passage = " ".join(f"w{i}" for i in range(60))
    fill = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    texts += [None, "", " \n\t", "one", "a\n\na\n b\na", "é#|é é", passage + " " + fill("x", 900) + " " + passage, passage + " " + fill("y", 300) + " " + passage, "same " * 300, "a\x0bb\x0cc\x1cd\x85e\u2003f"]
    limits = qr.RepetitionLimits()
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "x y", "z"), (0, texts[0], "z")], "doc_id long, text string, n_words string")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"]
    got = qr.judge(docs, limits).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "x y" if r.doc_id is None else texts[r.doc_id]
        assert tuple(r[c] for c in columns) == brute(text, limits)[0], r
    spans = {}
    for r in qr.repeated_spans(docs.where("doc_id > 0"), limits).collect():
        spans.setdefault(r.doc_id, []).append((r.begin, r.end))
    assert {k: sorted(v) for k, v in spans.items()} == {i: brute(t, limits)[1] for i, t in enumerate(texts) if i and brute(t, limits)[1]}
    assert qr.judge(docs.limit(0)).count() == 0


def test_very_long_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "the same " * 60000)], "doc_id long, text string")
    r = qr.judge(docs).collect()[0]
    assert r.n_words == 120000 and r.longest_repeat == 119998 and r.base_failed and not r.kept
