"""Byte-level byte-pair encoding on ragged numpy arrays, and what is built on it.

``Vocabulary.merge`` applies, in each round, every sequence's lowest-rank pair at once.
``Vocabulary.join_tree`` encodes long unsplit byte strings: leaves are encoded together, then
neighbours are joined level by level by encoding growing windows around each join again until
the window's outer tokens equal those of both sides.  ``Vocabulary.join_pieces`` does the same for
the pre-tokens of two halves of a text that was cut anywhere.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable

import numpy as np
import regex

#: The split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same pattern for texts whose characters are ASCII or Latin letters only; the standard
#: library runs it faster.  U+00C0 to U+024F are letters, but for the two signs left out.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_LATIN_PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t-\r{_LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""
#: \x1c to \x1f are left to the general pattern, as libraries differ on them.
_NOT_LATIN = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LATIN}]")

NONE = np.int32(2**31 - 1)
LEAF = 256


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ranks, ids and bytes read from a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] is None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space and normalizer is supported")
        chars = _byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        ids: dict[str, int] = spec["model"]["vocab"]
        added = [t for t in spec["added_tokens"] if t["content"]]
        self.base = 1 + max(max(ids.values()), *(t["id"] for t in added), 0)
        self.token_bytes: list[bytes] = [b""] * self.base
        for token, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token in added:
            self.token_bytes[token["id"]] = token["content"].encode()
        self.special = {t["content"]: t["id"] for t in added}
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        #: Characters beyond a pre-token's end that its end may hang on: a contraction's or a special string's.
        self.margin = max(3, *map(len, self.special), 0)
        self.byte_ids = np.array([ids[c] for c in chars], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.base + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(keys), dtype=np.int32)[order], made
        self.general, self.latin = regex.compile(PATTERN), re.compile(_LATIN_PATTERN)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        return (self.general if _NOT_LATIN.search(text) else self.latin).findall(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings of a whole text, in order."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split(text)
        return [p for part in self.special_split.split(text) if part for p in ([part] if part in self.special else self.split(part))]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all sequences, one after the other, and each sequence's number of ids."""
        lens = np.fromiter(map(len, seqs), dtype=np.int64, count=len(seqs))
        sym = self.byte_ids[np.frombuffer(b"".join(seqs), dtype=np.uint8)]
        own = np.repeat(np.arange(len(seqs), dtype=np.int32), lens)
        rank = np.full(len(sym), NONE, dtype=np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(own[1:] == own[:-1], self._rank(sym[:-1], sym[1:]), NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[starts, len(own)])
            low = np.minimum.reduceat(rank, starts)
            alive = low < NONE
            if not alive.all():
                mask = np.repeat(alive, size)
                done.append((own[~mask], sym[~mask]))
                own, sym, rank, low, size = own[mask], sym[mask], rank[mask], low[alive], size[alive]
                if not len(sym):
                    break
            low = np.repeat(low, size)
            hit = np.flatnonzero(rank == low)
            # in a run of one repeated symbol pairs overlap; every second one counts
            head = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
            sym[hit] = self.made[low[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            own, sym, rank = own[keep], sym[keep], rank[keep]
            change = np.concatenate([at, at[at > 0] - 1])
            inner = change[change < len(sym) - 1]
            rank[change] = NONE
            inner = inner[own[inner] == own[inner + 1]]
            rank[inner] = self._rank(sym[inner], sym[inner + 1])
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(len(seqs), dtype=np.int64)
        own, sym = np.concatenate([o for o, _ in done]), np.concatenate([s for _, s in done])
        return sym[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(seqs))

    def _arrays(self, seqs: list[bytes]) -> list[np.ndarray]:
        ids, lens = self.merge(seqs)
        return np.split(ids, np.cumsum(lens)[:-1]) if seqs else []

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def join_tree(self, data: bytes, leaf: int = LEAF) -> np.ndarray:
        """Ids of one long unsplit byte string, exactly as one merge of the whole would give.

        A sequence of tokens is the encoding of its bytes if each two neighbours are so; inside a
        window encoded afresh they are, and where the window's outer token equals the token that
        stood there before, the pair that crosses the window's edge is one of the old encoding.
        """
        level = self._arrays([data[i : i + leaf] for i in range(0, len(data), leaf)])
        while len(level) > 1:
            level = self.join_ids(list(zip(level[::2], level[1::2], strict=False))) + level[len(level) // 2 * 2 :]
        return level[0] if level else np.zeros(0, dtype=np.int32)

    def join_ids(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Ids of the joined bytes of each two sides of one unsplit string, all windows together."""
        joined: list[np.ndarray] = [None] * len(sides)  # type: ignore[list-item]
        width, open_ = 4, list(range(len(sides)))
        while open_:
            windows = self._arrays([self.bytes_of(sides[i][0][-width:].tolist()) + self.bytes_of(sides[i][1][:width].tolist()) for i in open_])
            still = []
            for i, window in zip(open_, windows, strict=True):
                left, right = sides[i]
                if (width >= len(left) or window[0] == left[-width]) and (width >= len(right) or window[-1] == right[width - 1]):
                    joined[i] = np.concatenate([left[:-width] if width < len(left) else left[:0], window, right[width:]])
                else:
                    still.append(i)
            open_, width = still, width * 2
        return joined

    def join_pieces(self, left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
        """Pre-tokens of the joined text of two halves, exactly as splitting the whole would give,
        and those of the window that was split again.

        Splitting goes from left to right and looks ``margin`` characters ahead at most.  So where
        a pre-token of the left ends that far before its end, the whole's ends too; and where one
        of the window and one of the right begin at one place, that far before the window's end,
        all that follows is the same.
        """
        width = 4
        while True:
            before, after = left[-width:], right[:width]
            text = "".join(before)
            window = self.pieces(text + "".join(after))
            if width >= len(left) or (len(text) >= self.margin and window[0] == before[0]):
                if width >= len(right):
                    return left[:-width] + window, window
                same = length = 0
                while same < min(len(after), len(window)) and length < self.margin and window[-1 - same] == after[-1 - same]:
                    same += 1
                    length += len(after[-same])
                if length >= self.margin:
                    window = window[: len(window) - same]
                    return left[:-width] + window + right[width - same :], window
            width *= 2

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece: special strings, short pieces in one merge, long ones by the tree."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        short: list[int] = []
        coded: list[bytes] = []
        for i, piece in enumerate(pieces):
            data = piece.encode()
            if piece in self.special:
                out[i] = np.array([self.special[piece]], dtype=np.int32)
            elif len(data) > 2 * LEAF:
                out[i] = self.join_tree(data)
            else:
                short.append(i)
                coded.append(data)
        for i, ids in zip(short, self._arrays(coded), strict=True):
            out[i] = ids
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One copy for each Python worker."""
    return Vocabulary(path)
