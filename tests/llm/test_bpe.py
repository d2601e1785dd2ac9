"""Token counts and the codec against the tokenizers library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rolecall.llm.bpe import vocabulary
from rolecall.llm.bpe_codec import Encoder, decoded, digests, encoded, halves, round_trip
from rolecall.llm.token_counts import count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ours(text):
    v = vocabulary(PATH)
    return [i for part in v.encode_pieces(v.pieces(text)) for i in part.tolist()]


def test_every_token_encodes_as_itself():
    # what makes the joins of the tree exact
    v = vocabulary(PATH)
    _, lens = v.merge([t for t in v.token_bytes[:50256]])
    assert (lens == 1).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab eét\n\t'sl1½²|#日<|endoftext|>\x1c\x85\xa0"), st.characters(codec="utf-8")), max_size=120))
def test_any_text(text):
    assert ours(text) == ids(text)


@pytest.mark.parametrize("alphabet", ["a", "ab", "thea", "é日", "0", "\n", " ", "=-"])
def test_long_unsplit(alphabet):
    rnd = random.Random(3)
    for n in (513, 5000):
        text = "".join(rnd.choice(alphabet) for _ in range(n))
        assert ours(text) == ids(text)
        v = vocabulary(PATH)
        data = text.encode()
        whole, _ = v.merge([data])
        assert v.join_tree(data, 7).tolist() == whole.tolist()


def by_tree(texts, leaf):
    encoder = Encoder(vocabulary(PATH), leaf)
    return [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode(texts)], encoder.joins


ANY = st.text(alphabet=st.one_of(st.sampled_from("ab eét\n\t'sl1½²|#日<|endoftext|>\x1c\x85\xa0"), st.characters(codec="utf-8")), max_size=120)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ANY, st.lists(st.sampled_from(["<|endoftext|>", "don't", "we'll", "  ", " \n ", "12", "!'", " é", "日本", "aaaa"]), max_size=30).map("".join)), max_size=4), st.integers(1, 9))
def test_tree_over_any_texts_wherever_the_cuts_fall(texts, leaf):
    got, joins = by_tree(texts, leaf)
    assert got == [ids(t) for t in texts]
    assert joins == sum(max(0, len(halves(t, leaf)) - 1) for t in texts)


def test_tree_over_long_documents():
    rnd = random.Random(4)
    parts = ["<|endoftext|>", "don't", "we'll ", "   ", " \n\n ", "123456", "!'\"", " été", "日本語", "a" * 700, "word ", "\t", "ﬁ́", "👩‍👩‍👧"]
    long = "".join(rnd.choice(parts) for _ in range(120_000))
    assert len(long.encode()) > 1_000_000
    texts = [long, "ab" * 500_000, "x" * 1_000_003, " " * 300_000, "日" * 100_000 + "本", "<|endoftext|>" * 20_000]
    got, joins = by_tree(texts, 1024)
    assert joins > 3000
    for a, b in zip(got, texts, strict=True):
        assert a == ids(b)


def test_tree_joins_documents():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    got, joins = by_tree(texts, 1024)
    assert joins > 100 and got == [ids(t or "") for t in texts]


TEXTS = [None, "", " ", "A b c.\n\nD", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "ab" * 4000, "word " * 600, "A b c.\n\nD"]


@pytest.fixture()
def docs(spark):
    rows = [(i if i != 3 else None, t, "old") for i, t in enumerate(TEXTS)] + [(1, "", "old")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_count_query(docs):
    got = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), len(ids(t or "")), len(ids(t or "")) > 512) for i, t, _ in map(tuple, docs.collect())]
    assert got == sorted(want, key=str)


def test_codec_query(docs):
    got = sorted(map(tuple, digests(round_trip(docs, PATH)).collect()), key=str)
    want = []
    for i, t, _ in map(tuple, docs.collect()):
        x = ids(t or "")
        want.append((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(LIBRARY.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_parts_agree_with_round_trip(docs):
    apart = docs.select("text", encoded(docs.text, PATH).alias("ids"))
    back = [(r.text or "", r.back) for r in apart.select("text", decoded(apart.ids, PATH).alias("back")).collect()]
    assert all(a == b for a, b in back)


def test_empty_table(docs):
    none = docs.limit(0)
    assert count_tokens(none, PATH).count() == 0
    assert digests(round_trip(none, PATH)).count() == 0
