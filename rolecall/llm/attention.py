"""A causal self-attention model of subword ids, in numpy.

One head of attention over the tokens before gives a hidden state, to which the last token adds its
own part; a softmax over it weighs several distributions of the next token: that of all tokens, that
after the last token, and some that go by the words of the corpus.  The latter continue a word as
known words with the same beginning go on; where a word ends, each has its own distribution of the
token that begins the next one: one is counted, the others are learned.  So a probability over the
full vocabulary costs a few multiplications, and those of all tokens sum to 1.

Sequences are cut into blocks of ``stride`` tokens.  A block's window is the block itself and the one
before, so windows overlap by half and each token is scored once, with at least ``stride`` tokens
(or all there are) before it in sight; later tokens are masked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MASKED, SCORE_LIMIT = np.float32(-1e9), np.float32(40)
#: Blocks worked on at once.
SLICE = 512
#: Squares of past gradients before the first one.
LEAST_SQUARE = np.float32(1e-4)
#: Ids of a row of what a pass has learned, so that passes are added up by ranges of ids.
RANGE = 1024


@dataclass
class CorpusCounts:
    """Counts of subwords of all words: ``total`` of each id, ``first`` of words that begin and ``last`` of
    words that end with it, and ``pairs`` of neighbours in words by ``keys`` (the one before *
    vocabulary + the one after, sorted).  ``starts`` tells the ids that only begin words."""

    starts: np.ndarray
    total: np.ndarray
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray

    def __post_init__(self) -> None:
        size, smooth = len(self.total), 0.1
        self.uni = ((self.total + smooth) / (self.total.sum() + smooth * size)).astype(np.float32)
        #: What of ``uni`` a token has where the token that begins a word is chosen apart.
        self.apart = np.where(self.starts, self.uni[self.starts].sum(), self.uni).astype(np.float32)
        begin = np.where(self.starts, self.first + smooth, 0)
        self.start = (begin / begin.sum()).astype(np.float32)
        kept = np.bincount(self.keys // size, weights=self.pairs, minlength=size) if len(self.keys) else np.zeros(size)
        # what pairs that aren't kept would have of the mass after an id goes by ``uni``
        self.rest = np.where(self.total > 0, 1 - (kept + self.last) / np.maximum(self.total, 1), 1.0).clip(0, 1).astype(np.float32)

    def pair(self, x: np.ndarray, y: np.ndarray, less: int = 0) -> np.ndarray:
        """Share of ``y`` in what follows ``x``, for kept pairs; else 0.  ``less``: 1 as if this occurrence hadn't been counted."""
        if not len(self.keys):
            return np.zeros(len(x), dtype=np.float32)
        key = x.astype(np.int64) * len(self.total) + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, (self.pairs[at] - less) / np.maximum(self.total[x] - less, 1), 0).astype(np.float32)

    def word_end(self, x: np.ndarray, less: int = 0) -> np.ndarray:
        """Share of word ends in what follows ``x``."""
        return (np.maximum(self.last[x] - less, 0) / np.maximum(self.total[x] - less, 1)).astype(np.float32)


class Blocks:
    """Token sequences, one after the other, in blocks: inputs (the token before, or ``end`` at a start) and targets."""

    def __init__(self, tokens: np.ndarray, lens: np.ndarray, end: int, stride: int) -> None:
        self.tokens, self.stride = tokens, stride
        start = np.cumsum(lens) - lens
        self.before = np.r_[tokens[:1], tokens[:-1]]
        self.before[start[lens > 0]] = end
        count = -(-lens // stride)
        own = np.repeat(np.arange(len(lens)), count)
        number = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        place = (start[own] + number * stride)[:, None] + np.arange(stride)
        self.valid = place < (start + lens)[own][:, None]
        self.place = np.where(self.valid, place, 0)
        self.inputs = np.where(self.valid, self.before[self.place], end)
        self.first = number == 0

    def __len__(self) -> int:
        return len(self.first)


class AttentionModel:
    def __init__(self, counts: CorpusCounts, end: int, dims: int, experts: int, stride: int, seed: int = 3) -> None:
        size, rng = len(counts.total), np.random.default_rng(seed)
        self.counts, self.end, self.stride, self.dims = counts, end, stride, dims
        self.made: tuple[np.ndarray, np.ndarray] | None = None
        #: Squares of past gradients, by which learning goes on.
        self.squares: dict[str, np.ndarray] = {}
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.q, self.k, self.v, self.own = (normal(size, dims) for _ in range(4))
        self.out, self.bias = normal(dims, experts + 3), np.zeros(experts + 3, dtype=np.float32)
        self.bias[1:3] = 1.0, 2.0
        self.near = np.zeros(2 * stride, dtype=np.float32)
        emit = counts.start[:, None] * rng.gamma(1.0, 1.0, (size, experts)).astype(np.float32)
        self.emit = emit / emit.sum(axis=0)
        #: Distance of each of the window's tokens from each of the block's; negative ones are masked.
        self.gap = np.arange(stride)[:, None] + stride - np.arange(2 * stride)[None, :]

    def _distance_bias(self) -> np.ndarray:
        return np.where(self.gap >= 0, self.near[np.maximum(self.gap, 0)], MASKED)[None]

    def _attend(self, blocks: Blocks, a: int, b: int, near: np.ndarray) -> tuple[np.ndarray, ...]:
        """Queries, keys and values of the windows of blocks a to b, and their attention weights."""
        q = self.q[blocks.inputs[a:b]]
        windows = np.concatenate([blocks.inputs[np.maximum(np.arange(a, b) - 1, 0)], blocks.inputs[a:b]], axis=1)
        k, v = self.k[windows], self.v[windows]
        weight = q @ k.transpose(0, 2, 1)
        weight *= np.float32(self.dims**-0.5)
        np.clip(weight, -SCORE_LIMIT, SCORE_LIMIT, out=weight)
        weight += near
        weight[blocks.first[a:b], :, : self.stride] = MASKED
        np.exp(weight, out=weight)
        weight /= weight.sum(axis=2, keepdims=True)
        return windows, q, k, v, weight

    def _gates(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def _choices(self, x: np.ndarray, y: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The probability of each ``y`` under each distribution."""
        counts = self.counts
        begins = counts.starts[y]
        start = np.where(begins, counts.start[y], 1)
        out = np.empty((len(y), 3 + self.emit.shape[1]), dtype=np.float32)
        out[:, 0] = counts.uni[y]
        out[:, 1] = pair * start + counts.rest[x] * counts.uni[y]
        out[:, 2:] = np.where(word < 0, pair + counts.rest[x] * counts.apart[y], word)[:, None]
        out[:, 2] *= start
        out[begins, 3:] *= self.emit[y[begins]]
        return out

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """One row a token, made once after training: query (scaled), key, value, 1 (sums the weights) and
        own part; and what the distributions give it: of all, 1, and word beginnings (1 for other tokens)."""
        if self.made is None:
            one = np.ones((len(self.counts.total), 1), dtype=np.float32)
            begins = self.counts.starts[:, None]
            table = np.concatenate([self.q * np.float32(self.dims**-0.5), self.k, self.v, one, self.own], axis=1)
            given = np.concatenate([self.counts.uni[:, None], one, np.where(begins, self.counts.start[:, None], 1), np.where(begins, self.emit, 1)], axis=1, dtype=np.float32)
            self.made = table, given
        return self.made

    def log10(self, tokens: np.ndarray, lens: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each token.

        For a token that begins a word, ``pair`` and ``word`` are the probabilities that the word before
        ends, after its last token and after all its tokens; for others they are those of the token
        after the one before and after all of its word.  ``word`` is negative where no known word
        has these tokens; it then goes by ``pair``.
        """
        blocks, near, d = Blocks(tokens, lens, self.end, self.stride), self._distance_bias(), self.dims
        table, given = self._tables()
        ones = np.ones(given.shape[1], dtype=np.float32)
        out = np.zeros(len(tokens), dtype=np.float32)
        for a in range(0, len(blocks), SLICE):
            b = min(a + SLICE, len(blocks))
            rows = table[blocks.inputs[np.r_[max(a - 1, 0), a:b]]]
            flat = rows.reshape(-1, rows.shape[2])
            windows = np.lib.stride_tricks.as_strided(flat, (b - a, 2 * self.stride, flat.shape[1]), (rows.strides[0], *flat.strides), writeable=False)
            weight = rows[1:, :, :d] @ windows[:, :, d : 2 * d].transpose(0, 2, 1)
            np.clip(weight, -SCORE_LIMIT, SCORE_LIMIT, out=weight)
            weight += near
            weight[blocks.first[a:b], :, : self.stride] = MASKED
            np.exp(weight, out=weight)
            seen = (weight @ windows[:, :, 2 * d : 3 * d + 1]).reshape(-1, d + 1)
            hidden = seen[:, :d] / seen[:, d:]
            hidden += flat[self.stride :, 3 * d + 1 :]
            gates = hidden @ self.out
            gates += self.bias
            np.exp(np.clip(gates, -SCORE_LIMIT, SCORE_LIMIT, out=gates), out=gates)
            total = gates @ ones
            at, x = blocks.place[a:b].ravel(), blocks.inputs[a:b].ravel()
            y = tokens[at]
            p, part = pair[at], word[at]
            unknown = np.flatnonzero(part < 0)
            part[unknown] = p[unknown] + self.counts.rest[x[unknown]] * self.counts.apart[tokens[at[unknown]]]
            chance = given[tokens[at]]
            gates *= chance
            gates[:, 1] *= p * chance[:, 2] + self.counts.rest[x] * chance[:, 0]
            gates[:, 2:] *= part[:, None]
            valid = blocks.valid[a:b].ravel()
            out[at[valid]] = ((gates @ ones) / total)[valid]
        return np.log10(out, out=out)

    def fit(self, tokens: np.ndarray, lens: np.ndarray, pair: np.ndarray, word: np.ndarray, epochs: int = 3, rate: float = 0.1, batch: int = 64, refresh: int = 8, inertia: float = 500.0, seed: int = 4) -> None:
        """Stochastic gradient descent (scaled by past gradients) for attention and gates; the learned
        distributions follow by the share that they had in the tokens seen lately.  ``pair`` and
        ``word`` are as if the token itself hadn't been counted."""
        blocks = Blocks(tokens, lens, self.end, self.stride)
        if not len(blocks):
            return
        self.made = None
        rng, squares = np.random.default_rng(seed), self.squares
        seen = self.emit * np.float32(inertia)
        batches = [(a, min(a + batch, len(blocks))) for a in range(0, len(blocks), batch)]
        for _ in range(epochs):
            for turn, i in enumerate(rng.permutation(len(batches))):
                a, b = batches[i]
                near = self._distance_bias()
                windows, q, k, v, weight = self._attend(blocks, a, b, near)
                valid, x = blocks.valid[a:b], blocks.inputs[a:b]
                hidden = (weight @ v)[valid] + self.own[x[valid]]
                at = blocks.place[a:b][valid]
                gates, choices = self._gates(hidden), self._choices(x[valid], tokens[at], pair[at], word[at])
                share = gates * choices
                share /= share.sum(axis=1, keepdims=True)
                begins = self.counts.starts[tokens[at]]
                np.add.at(seen, tokens[at[begins]], share[begins, 3:])
                d_z = gates - share
                d_hidden = np.zeros((b - a, self.stride, self.dims), dtype=np.float32)
                d_hidden[valid] = d_z @ self.out.T
                d_weight = d_hidden @ v.transpose(0, 2, 1)
                d_score = weight * (d_weight - (weight * d_weight).sum(axis=2, keepdims=True))
                near_of = np.bincount(np.maximum(self.gap, 0).ravel(), weights=d_score.sum(axis=0).ravel(), minlength=2 * self.stride)
                d_score *= np.float32(self.dims**-0.5)
                self._step(squares, "out", None, hidden.T @ d_z, rate)
                self._step(squares, "bias", None, d_z.sum(axis=0), rate)
                self._step(squares, "near", None, near_of, rate)
                self._step(squares, "own", x[valid], d_hidden[valid], rate)
                self._step(squares, "q", x.ravel(), (d_score @ k).reshape(-1, self.dims), rate)
                self._step(squares, "k", windows.ravel(), (d_score.transpose(0, 2, 1) @ q).reshape(-1, self.dims), rate)
                self._step(squares, "v", windows.ravel(), (weight.transpose(0, 2, 1) @ d_hidden).reshape(-1, self.dims), rate)
                if turn % refresh == refresh - 1:
                    grown = seen + 5 * self.counts.start[:, None]
                    self.emit = (grown / grown.sum(axis=0)).astype(np.float32)
                    seen *= np.float32(0.9)

    def take(self, rows: list[tuple[int, bytes, bytes, bytes]]) -> None:
        """Takes over what passes over all texts gave, added up: ``rows`` of all ranges."""
        self.made, self.squares = None, {}
        grown = 5.0 * self.counts.start[:, None] + np.zeros(self.emit.shape)
        for number, *data in rows:
            times, change, seen = (np.frombuffer(x) for x in data)
            mean = (change.reshape(len(times), -1) / np.maximum(times, 1)[:, None]).astype(np.float32)
            if number < 0:
                begin = 0
                for table in (getattr(self, n) for n in Pass.DENSE):
                    table += mean[0, begin : begin + table.size].reshape(table.shape)
                    begin += table.size
                continue
            at = slice(number * RANGE, number * RANGE + len(times))
            for i, name in enumerate(Pass.TABLES):
                getattr(self, name)[at] += mean[:, i * self.dims : (i + 1) * self.dims]
            grown[at] += seen.reshape(len(times), -1)
        self.emit = (grown / grown.sum(axis=0)).astype(np.float32)

    def _step(self, squares: dict[str, np.ndarray], name: str, rows: np.ndarray | None, gradient: np.ndarray, rate: float) -> None:
        table = getattr(self, name)
        past = squares.setdefault(name, np.full(table.shape, LEAST_SQUARE, dtype=np.float32))
        if rows is None:
            past += gradient.astype(np.float32) ** 2
            table -= rate * gradient / np.sqrt(past)
            return
        order = np.argsort(rows, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
        which, total = rows[order[begin]], np.add.reduceat(gradient[order], begin, axis=0)
        past[which] += total * total
        table[which] -= rate * total / np.sqrt(past[which])


class Pass:
    """One pass of gradient descent over any number of texts, as ``AttentionModel.fit`` makes it, from a model on.

    Several passes over parts of the texts, from one model, are added up (``added``): a parameter's changes
    count by how often the part has its token, the shares of the learned distributions are sums over all
    texts.  ``rows`` and ``added`` hold ids by ranges, and a last range (-1) for what is of no id.
    """

    TABLES, DENSE = ("q", "k", "v", "own"), ("out", "bias", "near")

    def __init__(self, model: AttentionModel, rate: float = 0.1, refresh: int = 64, inertia: float = 500.0) -> None:
        self.model, self.rate, self.refresh, self.turn = model, np.float32(rate), refresh, 0
        past = lambda name: model.squares.get(name, np.full(getattr(model, name).shape, LEAST_SQUARE, dtype=np.float32)).copy()
        self.table = np.concatenate([getattr(model, n) for n in self.TABLES], axis=1)
        self.past = np.concatenate([past(n) for n in self.TABLES], axis=1)
        self.dense = {n: getattr(model, n).copy() for n in self.DENSE}
        self.dense_past = {n: past(n) for n in self.DENSE}
        size, experts = model.emit.shape
        self.times, self.seen = np.zeros(size), np.zeros((size, experts))
        self.held = inertia * model.emit + 5 * model.counts.start[:, None]
        self.given: np.ndarray | None = None

    def _given(self) -> np.ndarray:
        """What the distributions give each id, with the shares seen so far (see ``AttentionModel._tables``)."""
        if self.given is None or self.turn % self.refresh == 0:
            counts, grown = self.model.counts, self.held + self.seen
            begins, one = counts.starts[:, None], np.ones((len(grown), 1), dtype=np.float32)
            self.given = np.concatenate([counts.uni[:, None], one, np.where(begins, counts.start[:, None], 1), np.where(begins, grown / grown.sum(axis=0), 1)], axis=1, dtype=np.float32)
        self.turn += 1
        return self.given

    def learn(self, tokens: np.ndarray, lens: np.ndarray, pair: np.ndarray, word: np.ndarray) -> None:
        """Learns from all tokens; ``pair`` and ``word`` are as if the token itself hadn't been counted."""
        model, counts, d, stride = self.model, self.model.counts, self.model.dims, self.model.stride
        blocks, scale = Blocks(tokens, lens, model.end, stride), np.float32(model.dims**-0.5)
        for a in range(0, len(blocks), SLICE):
            b = min(a + SLICE, len(blocks))
            given, near, out = self._given(), np.where(model.gap >= 0, self.dense["near"][np.maximum(model.gap, 0)], MASKED)[None], self.dense["out"]
            ids = blocks.inputs[np.r_[max(a - 1, 0), a:b]]
            rows = self.table[ids]
            flat = rows.reshape(-1, 4 * d)
            windows = np.lib.stride_tricks.as_strided(flat, (b - a, 2 * stride, 4 * d), (rows.strides[0], *flat.strides), writeable=False)
            q, k, v = rows[1:, :, :d] * scale, windows[:, :, d : 2 * d], windows[:, :, 2 * d : 3 * d]
            weight = q @ k.transpose(0, 2, 1)
            np.clip(weight, -SCORE_LIMIT, SCORE_LIMIT, out=weight)
            weight += near
            weight[blocks.first[a:b], :, :stride] = MASKED
            np.exp(weight, out=weight)
            weight /= (weight @ np.ones(2 * stride, dtype=np.float32))[:, :, None]
            mixed = weight @ v
            hidden = (mixed + rows[1:, :, 3 * d :]).reshape(-1, d)
            gates = hidden @ out
            gates += self.dense["bias"]
            np.exp(np.clip(gates, -SCORE_LIMIT, SCORE_LIMIT, out=gates), out=gates)
            ones = np.ones(gates.shape[1], dtype=np.float32)
            gates /= (gates @ ones)[:, None]
            at, x = blocks.place[a:b].ravel(), ids[1:].ravel()
            y, p, part = tokens[at], pair[at], word[at]
            unknown = np.flatnonzero(part < 0)
            part[unknown] = p[unknown] + counts.rest[x[unknown]] * counts.apart[y[unknown]]
            share = given[y]
            share[:, 1] = p * share[:, 2] + counts.rest[x] * share[:, 0]
            share[:, 2:] *= part[:, None]
            share *= gates
            share /= np.maximum(share @ ones, np.float32(1e-30))[:, None]
            valid = blocks.valid[a:b].ravel()
            begins = np.flatnonzero(valid & counts.starts[y])
            which, total = _sums(y[begins], share[begins, 3:])
            self.seen[which] += total
            d_z = gates - share
            d_z[~valid] = 0
            d_hidden = (d_z @ out.T).reshape(b - a, stride, d)
            d_score = d_hidden @ v.transpose(0, 2, 1)
            mixed *= d_hidden
            d_score -= (mixed @ np.ones(d, dtype=np.float32))[:, :, None]
            d_score *= weight
            change = np.empty((b - a + 1, stride, 4 * d), dtype=np.float32)
            change[0] = 0
            np.matmul(d_score, k, out=change[1:, :, :d])  # still to be scaled
            change[1:, :, 3 * d :] = d_hidden
            # what a window's first half gives goes to the block before, which has what it gave itself
            for c, score, of in ((d, d_score, q), (2 * d, weight, d_hidden)):
                score = score.transpose(0, 2, 1)
                np.matmul(score[:, stride:], of, out=change[1:, :, c : c + d])
                change[:-1, :, c : c + d] += score[:, :stride] @ of
            self.times += np.bincount(x[valid], minlength=len(self.times))
            which, total = _sums(ids.ravel(), change.reshape(-1, 4 * d))
            total[:, :d] *= scale
            past = self.past[which] + total * total
            self.past[which] = past
            self.table[which] -= self.rate * total / np.sqrt(past)
            of_near = np.bincount(np.maximum(model.gap, 0).ravel(), weights=d_score.sum(axis=0).ravel(), minlength=2 * stride)
            for name, gradient in (("out", hidden.T @ d_z), ("bias", d_z.sum(axis=0)), ("near", of_near)):
                self.dense_past[name] += gradient.astype(np.float32) ** 2
                self.dense[name] -= self.rate * gradient.astype(np.float32) / np.sqrt(self.dense_past[name])

    def rows(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """What this pass gives: of each range its number, how often its ids were met, their changes times that, and their shares."""
        for a in range(0, len(self.times), RANGE):
            at = slice(a, a + RANGE)
            change = self.times[at, None] * (self.table[at] - np.concatenate([getattr(self.model, n)[at] for n in self.TABLES], axis=1))
            yield a // RANGE, self.times[at].tobytes(), change.tobytes(), self.seen[at].tobytes()
        total = self.times.sum()
        dense = np.concatenate([(self.dense[n] - getattr(self.model, n)).ravel() for n in self.DENSE]).astype(np.float64)
        yield -1, np.array([total]).tobytes(), (total * dense).tobytes(), b""


def added(parts: list[tuple[bytes, bytes, bytes]]) -> tuple[bytes, bytes, bytes]:
    """What several passes give of one range, added up."""
    return tuple(sum(np.frombuffer(part[i]) for part in parts).tobytes() for i in range(3))


def _sums(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and the sum of the rows of each."""
    if not len(ids):
        return ids, rows
    # short whole numbers are sorted by radix
    order = np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    return ids[order[begin]], np.add.reduceat(rows[order], begin, axis=0)
