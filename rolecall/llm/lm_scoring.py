"""LM scoring: a causal self-attention model of subword ids, trained in numpy, over whole texts.

One pass over the learned-from documents counts words; Spark adds the counts up, and the subwords of
each distinct word, and pairs of them, are counted from that.  The most frequent words and pairs, bounded
in number, go into the model and to every task.  Its attention and gates begin with a few passes over some of the
texts, and then learn from all of them: each core goes once over its part, and what the parts
have learned is added up by ranges of ids.  A last pass scores all texts: a worker remembers what a word gives (its subwords and their counted probabilities), and the
attention model scores windows of tokens in batches.  Words that aren't among the frequent ones
leave the pass as rows, and meet their counts by a join.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import AttentionModel, CorpusCounts, Pass, added
from .bpe import LEAF, Vocabulary, vocabulary
from .common import small_batches, spans, text_hash, unit_hash, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands for the end of a text among its words; no word holds a space.
END = b" "
#: Bytes of text worked on at a time.
CHUNK = 1_000_000
#: Bytes of a batch of rows on its way to a worker, which holds one in several copies.
BATCH = 4_000_000


@dataclass(frozen=True)
class LmParams:
    """At most ``known`` words and ``pairs`` pairs of subwords come to the driver and to tasks, with
    their counts; attention learns from all texts, after a beginning with about ``fit_tokens`` tokens of texts chosen by a hash.  A
    worker adds up ``gathered`` words at a time, and remembers ``remembered`` words besides the known."""

    known: int = 1 << 17
    pairs: int = 1 << 20
    fit_tokens: int = 300_000
    dims: int = 16
    experts: int = 13
    stride: int = 16
    gathered: int = 250_000
    remembered: int = 120_000
    seed: int = 13


def words_of(text: str | None) -> list[bytes]:
    """A text's words, A-Z lower-cased, and its end."""
    return [*(text.encode().translate(_LOWER).split() if text else ()), END]


def _numbered(number: defaultdict[bytes, int], words: list[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of all words of all lists, and the words that had none before, in the order of their new numbers."""
    before, number.default_factory = len(number), count(len(number)).__next__
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=sum(map(len, words)))
    number.default_factory = None
    return ids, list(islice(reversed(number), len(number) - before))[::-1]


def _prefix_codes(tokens: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A code of the word's tokens up to each token."""
    start = np.cumsum(lens) - lens
    out = np.zeros(len(tokens), dtype=np.uint64)
    open_, code = np.flatnonzero(lens > 0), np.zeros(len(lens), dtype=np.uint64)
    k = 0
    while len(open_):
        code[open_] = (code[open_] + tokens[start[open_] + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        code[open_] ^= code[open_] >> np.uint64(31)
        out[start[open_] + k] = code[open_]
        k += 1
        open_ = open_[lens[open_] > k]
    return out


class Subwords:
    """Subword ids of words by a vocabulary file; the end of a text is an id of its own."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.end = vocab, vocab.base
        self.starts = np.array([*(t[:1] == b" " for t in vocab.token_bytes), True])

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each; a word is encoded after a space."""
        place: dict[bytes, int] = {}
        pieces: list[int] = []
        counts = np.ones(len(words), dtype=np.int64)
        odd: dict[int, np.ndarray] = {}
        for i, w in enumerate(words):
            if w.isalpha():  # letters of ASCII are never parted
                pieces.append(place.setdefault(b" " + w, len(place)))
            elif w == END:
                pieces.append(place.setdefault(b"", len(place)))  # no piece is empty
                odd[pieces[-1]] = np.array([self.end], dtype=np.int32)
            else:
                t = w.decode()
                head = t[:-1]
                if t.isalpha():
                    parts = [" " + t]
                elif head.isalpha() and t[-1] in ".,;:!?":
                    parts = [" " + head, t[-1]]
                else:
                    parts = self.vocab.pieces(" " + t)
                counts[i] = len(parts)
                for part in parts:
                    n = place.setdefault(part.encode(), len(place))
                    pieces.append(n)
                    if part in self.vocab.special:
                        odd[n] = np.array([self.vocab.special[part]], dtype=np.int32)
        kinds = list(place)
        for n, data in enumerate(kinds):
            if len(data) > 2 * LEAF and n not in odd:
                odd[n] = self.vocab.join_tree(data)
        ids, lens = self.vocab.merge([b"" if n in odd else data for n, data in enumerate(kinds)] if odd else kinds)
        if odd:
            lens[list(odd)] = [len(x) for x in odd.values()]
            start = np.cumsum(lens) - lens
            whole = np.zeros(int(lens.sum()), dtype=np.int32)
            theirs = np.ones(len(whole), dtype=bool)
            for n, x in odd.items():
                whole[start[n] : start[n] + len(x)] = x
                theirs[start[n] : start[n] + len(x)] = False
            whole[theirs] = ids
            ids = whole
        start = np.cumsum(lens) - lens
        which = np.array(pieces, dtype=np.int64)
        size = lens[which]
        at = np.repeat(start[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return ids[at], (np.add.reduceat(size, np.cumsum(counts) - counts) if len(words) else size)


class Places:
    """Places of distinct codes, by open addressing in arrays."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, bits = codes, max(4, int(2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        open_, slot = np.arange(len(codes)), self._first(codes)
        while len(open_):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = open_[free]
            lost = self.slots[slot] != open_
            open_, slot = open_[lost], (slot[lost] + 1) & self.mask

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 if there is none."""
        slot = self._first(codes)
        out = self.slots[slot].copy()
        open_ = np.flatnonzero((out >= 0) & (self.codes[out] != codes)) if len(self.codes) else np.zeros(0, dtype=np.int64)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = self.slots[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.codes[out[open_]] != codes[open_])]
        return out


class WordTree:
    """The known words by their subwords: how many words have each prefix, and how many end with it."""

    def __init__(self, subwords: Subwords, words: list[bytes], counts: np.ndarray) -> None:
        tokens, lens = subwords.of(words)
        codes, place = np.unique(_prefix_codes(tokens, lens), return_inverse=True)
        self.places = Places(codes)
        # one more line stands for all that isn't there
        self.passing = np.r_[np.bincount(place, weights=np.repeat(counts, lens), minlength=len(codes)), 0.0]
        last = place[np.cumsum(lens)[lens > 0] - 1]
        self.ending = np.r_[np.bincount(last, weights=counts[lens > 0], minlength=len(codes)), 0.0]

    def chances(self, tokens: np.ndarray, lens: np.ndarray, less: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token but the first its share among words with the same tokens before it, for each
        word the share of words that end where it does; negative where no known word has these tokens."""
        place = self.places.find(_prefix_codes(tokens, lens))
        here = self.passing[place]
        before = np.r_[0.0, here[:-1]] if len(here) else here
        start = (np.cumsum(lens) - lens)[lens > 0]
        last = np.cumsum(lens)[lens > 0] - 1
        ends = np.full(len(lens), -1.0)
        share = lambda a, b: np.where(b - less > 0, np.maximum(a - less, 0) / np.maximum(b - less, 1e-9), -1.0)
        ends[lens > 0] = share(self.ending[place[last]], here[last])
        chance = share(here, before).astype(np.float32)
        chance[start] = 0  # goes by the word before
        return chance, ends.astype(np.float32)


class Lexicon:
    """Words met so far by number, and for each its subwords with their counted probabilities.

    ``less`` is 1 where the texts were counted themselves (see ``CorpusCounts.pair``).
    """

    def __init__(self, subwords: Subwords | None, counts: CorpusCounts, tree: WordTree, less: int = 0) -> None:
        self.subwords, self.counts, self.tree, self.less = subwords, counts, tree, less
        self.number: defaultdict[bytes, int] = defaultdict()
        self.listed: list[bytes] = []
        self.fixed = 0
        self.size, self.start = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.tokens = np.zeros(0, dtype=np.int32)
        self.pair = self.word = self.ends = self.pair_ends = np.zeros(0, dtype=np.float32)

    def fix(self, words: list[bytes]) -> None:
        """Adds the first words, which are never forgotten."""
        self.numbers([words])
        self.fixed = len(self.listed)

    def forget(self, most: int) -> None:
        """Drops all but the fixed words if more than ``most`` others are held."""
        if len(self.listed) <= self.fixed + most:
            return
        for w in self.listed[self.fixed :]:
            del self.number[w]
        del self.listed[self.fixed :]
        kept = int(self.size[: self.fixed].sum())
        for name in ("size", "start", "ends", "pair_ends"):
            setattr(self, name, getattr(self, name)[: self.fixed])
        for name in ("tokens", "pair", "word"):
            setattr(self, name, getattr(self, name)[:kept])

    def numbers(self, words: list[list[bytes]]) -> np.ndarray:
        """Numbers of all words of all lists."""
        ids, new = _numbered(self.number, words)
        if new:
            self.listed += new
            tokens, size = self.subwords.of(new)
            self.tokens, self.size = np.r_[self.tokens, tokens], np.r_[self.size, size]
            before = np.r_[tokens[:1], tokens[:-1]]
            word, ends = self.tree.chances(tokens, size, self.less)
            self.pair, self.word = np.r_[self.pair, self.counts.pair(before, tokens, self.less)], np.r_[self.word, word]
            self.ends, self.pair_ends = np.r_[self.ends, ends], np.r_[self.pair_ends, self.counts.word_end(tokens[np.cumsum(size) - 1], self.less)]
            self.start = np.cumsum(self.size) - self.size
        return ids

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the subwords of a sequence of words stand, and the first of each word among them."""
        lens = self.size[ids]
        first = np.cumsum(lens) - lens
        return np.repeat(self.start[ids] - first, lens) + np.arange(int(lens.sum())), first

    def sequences(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens of texts of ``lens`` words, tokens of each text, and for each token what ``AttentionModel.log10`` takes."""
        place, first = self.places(ids)
        tokens = self.tokens[place]
        begins = np.cumsum(lens) - lens
        sizes = np.add.reduceat(self.size[ids], begins) if len(lens) else np.zeros(0, dtype=np.int64)
        pair, word = self.pair[place], self.word[place]
        for chance, ends in ((pair, self.pair_ends), (word, self.ends)):
            before = np.r_[np.float32(1), ends[ids][:-1]]
            before[begins] = 1.0  # a text begins with a word
            chance[first] = before
        return tokens, sizes, pair, word


def _counted(docs: DataFrame, params: LmParams) -> DataFrame:
    """word and n of each distinct word."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number: defaultdict[bytes, int] = defaultdict()
        times = np.zeros(0, dtype=np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in spans([len(t or "") for t in texts], CHUNK):
                ids, new = _numbered(number, [words_of(t) for t in texts[begin:end]])
                times = np.r_[times, np.zeros(len(new), dtype=np.int64)] + np.bincount(ids, minlength=len(number))
                if len(number) > params.gathered:
                    yield pd.DataFrame({"word": list(number), "n": times})
                    number, times = defaultdict(), times[:0]
        yield pd.DataFrame({"word": np.array([*number, None], dtype=object)[:-1], "n": times})

    return docs.select("text").mapInPandas(counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _subwords_counted(words: DataFrame, path: str, params: LmParams) -> DataFrame:
    """before, after and n: pairs of subwords in all words; before is -1 at a word's start, after -1 at its end."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subwords = Subwords(vocabulary(path))
        width = subwords.end + 2
        keys = pairs = np.zeros(0, dtype=np.int64)
        for batch in batches:
            tokens, lens = subwords.of(batch["word"].tolist())
            n = batch["n"].to_numpy()
            last = np.cumsum(lens) - 1
            key = np.r_[tokens[:1] * 0 - 1, tokens[:-1]].astype(np.int64)
            key[last - lens + 1] = -1
            key = np.r_[(key + 1) * width + tokens + 1, (tokens[last].astype(np.int64) + 1) * width]
            keys, place = np.unique(np.r_[keys, key], return_inverse=True)
            pairs = np.bincount(place, weights=np.r_[pairs, np.repeat(n, lens), n], minlength=len(keys)).astype(np.int64)
            if len(keys) > params.pairs:
                yield pd.DataFrame({"before": keys // width - 1, "after": keys % width - 1, "n": pairs})
                keys = pairs = keys[:0]
        width = max(width, 1)
        yield pd.DataFrame({"before": keys // width - 1, "after": keys % width - 1, "n": pairs})

    return words.mapInPandas(count, "before long, after long, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


def _learned(docs: DataFrame, path: str, model: AttentionModel, lexicon: Lexicon, params: LmParams) -> list:
    """What passes over all texts give, from ``model`` on, added up: a row for each range of ids (see ``Pass.rows``).

    There are as many passes as cores, so that what they give, some 300 bytes for each id, doesn't grow with the texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, lexicon))  # in a function, workers would hold it pickled too

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, lexicon = sent.value
        own, lexicon.subwords = Pass(model), Subwords(vocabulary(path))
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in spans([len(t or "") for t in texts], CHUNK):
                words = [words_of(t) for t in texts[begin:end]]
                lexicon.forget(params.remembered)
                own.learn(*lexicon.sequences(lexicon.numbers(words), np.array(list(map(len, words)), dtype=np.int64)))
        for row in own.rows() if own.times.any() else ():
            yield pd.DataFrame([row], columns=["range", "times", "change", "seen"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows["range"].iloc[0], *added(list(rows[["times", "change", "seen"]].itertuples(index=False))))], columns=rows.columns)

    kinds = "range int, times binary, change binary, seen binary"
    rows = docs.select("text").coalesce(docs.sparkSession.sparkContext.defaultParallelism).mapInPandas(learn, kinds).groupBy("range").applyInPandas(add, kinds)
    try:
        return written(rows, "lm-learned").collect()
    finally:
        sent.destroy()


def _least(lines: list, most: int) -> int | None:
    """The least size class whose members, with those of all larger ones, are ``most`` at most."""
    total, least = 0, None
    for r in sorted(lines, key=lambda r: -r["class"]):
        total += r["kinds"]
        if total > most:
            break
        least = r["class"]
    return least


@dataclass
class LanguageModel:
    """The model, the counts of the lexicon's fixed words, and of the learned-from texts the number of
    tokens and of distinct ones."""

    path: str
    known: np.ndarray
    tokens: int
    distinct: int
    attention: AttentionModel
    lexicon: Lexicon
    rare: DataFrame | None = None  # word and n of the other words

    def base(self, n: np.ndarray | Column) -> np.ndarray | Column:
        """log10 of the smoothed share of a word that occurs ``n`` times."""
        log = F.log10 if isinstance(n, Column) else np.log10
        return log((n + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def train(docs: DataFrame, path: str, params: LmParams = LmParams(), doc_id: str = "doc_id", text: str = "text") -> LanguageModel:
    """Counts all of ``docs`` and trains the model, with the vocabulary file ``path`` (read on executors too).

    Null texts count as empty.  The texts that attention begins with go by a hash of the id; it learns
    from those of all rows, also where the id is null.  An empty table gives a model under which all
    tokens are equally likely.
    """
    with small_batches(docs.sparkSession, BATCH):
        return _trained(docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")), path, params)


def _trained(docs: DataFrame, path: str, params: LmParams) -> LanguageModel:
    words = written(_counted(docs, params), "lm-words")
    pairs = written(_subwords_counted(words, path, params), "lm-pairs")
    size = F.floor(F.log2("n") * 8).cast("int")
    classes = lambda df: df.groupBy(size.alias("class")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()
    of_words = classes(words)
    least = _least(of_words, params.known)
    known = {} if least is None else {bytes(r["word"]): r["n"] for r in words.where(size >= least).collect()}
    subwords = Subwords(vocabulary(path))
    width = subwords.end + 1
    inner = pairs.where("before >= 0 and after >= 0")

    def by_id(rows: DataFrame, column: str) -> np.ndarray:
        out = np.zeros(width, dtype=np.int64)
        for r in rows.groupBy(F.col(column).alias("id")).agg(F.sum("n").alias("n")).collect():
            out[r["id"]] = r["n"]
        return out

    least_pair = _least(classes(inner), params.pairs)
    kept = inner.where(size >= least_pair).toPandas() if least_pair is not None else pd.DataFrame({"before": [], "after": [], "n": []}, dtype="int64")
    key = kept["before"].to_numpy() * width + kept["after"].to_numpy()
    order = np.argsort(key)
    totals = by_id(pairs.where("after >= 0"), "after")
    counts = CorpusCounts(subwords.starts, totals, by_id(pairs.where("before < 0"), "after"), by_id(pairs.where("after < 0"), "before"), key[order], kept["n"].to_numpy()[order])
    ordered = sorted(known)
    times = np.array([known[w] for w in ordered], dtype=np.int64)
    tree = WordTree(subwords, ordered, times)
    model = AttentionModel(counts, subwords.end, params.dims, params.experts, params.stride, params.seed)
    total = int(totals.sum())
    if total:
        share = min(1.0, params.fit_tokens / total)
        sample = docs.where(unit_hash(F.col("id"), params.seed) < share).orderBy(unit_hash(F.col("id"), params.seed), text_hash(F.col("text"))).select("text").collect()
        lexicon = Lexicon(subwords, counts, tree, less=1)
        lexicon.fix(ordered)
        texts = [words_of(r["text"]) for r in sample]
        if texts:
            model.fit(*lexicon.sequences(lexicon.numbers(texts), np.array(list(map(len, texts)))))
        lexicon.forget(0)
        lexicon.subwords = None  # each worker reads the vocabulary itself
        del sample, texts
        model.take(_learned(docs, path, model, lexicon, params))
    lexicon = Lexicon(subwords, counts, tree)
    lexicon.fix(ordered)
    lexicon.subwords = None
    at = np.fromiter((lexicon.number[w] for w in ordered), dtype=np.int64, count=len(ordered))
    of_number = np.zeros(len(ordered), dtype=np.int64)
    of_number[at] = times
    rare = words if least is None else words.where(size < least)
    return LanguageModel(path, of_number, sum(r["n"] for r in of_words), sum(r["kinds"] for r in of_words), model, lexicon, rare)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, times array<long>"


def score(docs: DataFrame, model: LanguageModel, params: LmParams = LmParams(), doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words and one end; a null text counts as empty and has its end alone.
    ``base_score`` is the sum of the logarithms (base 10) of the tokens' smoothed shares, ``score`` the
    model's log10 probability of the text.  Repeated rows stay, null ids stay null, an empty table
    gives no rows; ids are whole numbers, and other columns are neither read nor returned.
    """
    rare = model.rare
    # tasks of a worker share it, and the words that its lexicon remembers
    sent = docs.sparkSession.sparkContext.broadcast((model.path, model.known, model.tokens, model.distinct, model.attention, model.lexicon))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(*sent.value)
        lexicon = own.lexicon
        lexicon.subwords = Subwords(vocabulary(own.path))
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in spans([len(t or "") for t in texts], CHUNK):
                words = [words_of(t) for t in texts[begin:end]]
                lexicon.forget(params.remembered)
                ids, lens = lexicon.numbers(words), np.array(list(map(len, words)), dtype=np.int64)
                first = np.cumsum(lens) - lens
                tokens, sizes, pair, word = lexicon.sequences(ids, lens)
                logs = own.attention.log10(tokens, sizes, pair, word)
                known = ids < lexicon.fixed
                n = np.append(own.known, 0)[np.where(known, ids, len(own.known))]
                key, times = np.unique((np.repeat(np.arange(len(lens)), lens) * len(lexicon.listed) + ids)[~known], return_counts=True)
                cut = np.searchsorted(key, np.arange(1, len(lens)) * len(lexicon.listed))
                rare_words = np.empty(len(key), dtype=object)
                rare_words[:] = [lexicon.listed[i] for i in (key % len(lexicon.listed)).tolist()]
                part = batch.iloc[begin:end]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                        "held_out": part["held_out"].to_numpy(),
                        "n_tokens": lens,
                        "n_known": np.add.reduceat(known.astype(np.int64), first),
                        "base_score": np.add.reduceat(np.where(known, own.base(n), 0.0), first),
                        "score": np.add.reduceat(logs, np.cumsum(sizes) - sizes, dtype=np.float64),
                        "rare": np.split(rare_words, cut),
                        "times": np.split(times, cut),
                    }
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    try:
        with small_batches(docs.sparkSession, BATCH):
            scored = written(rows.mapInPandas(judge, _SCORED).withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    finally:
        sent.destroy()
    terms = scored.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("_x")).select("_row", F.col("_x.rare").alias("word"), F.col("_x.times").alias("times"))
    found = terms.join(rare, "word", "left")
    sums = found.groupBy("_row").agg(F.sum(F.col("times") * model.base(F.coalesce("n", F.lit(0)))).alias("_base"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("_known"))
    return scored.drop("rare", "times").join(sums, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score",
    )


def score_held_out(docs: DataFrame, path: str, params: LmParams = LmParams()) -> DataFrame:
    """Learns from documents whose remainder (crc32 of the id as text, modulo 10) is not 0, and scores
    all; ``held_out`` says that it is 0.  Documents with a null id are neither learned from nor held out."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    model = train(docs.where(remainder != 0), path, params)
    return score(docs, model, params, held_out=F.coalesce(remainder == 0, F.lit(False)))
