"""Words of a batch of texts as integer arrays, with a bounded memory of what each word gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .common import spans

#: Bytes of text worked on at a time, words that a worker remembers, and new words worked out at a time.
CHUNK, REMEMBERED, NEW = 1_000_000, 150_000, 8_192


class WordTable:
    """Numbers words and holds one row of a numpy array for each.

    ``rows`` gives an array with one row for each of a list of words.  The table is emptied when
    it grows beyond ``REMEMBERED`` words, so memory stays bounded whatever the texts hold.
    """

    def __init__(self, rows: Callable[[list[bytes]], np.ndarray], most: int = REMEMBERED) -> None:
        self.make, self.most = rows, most
        self.known: dict[bytes, int] = {}
        self.values: np.ndarray | None = None
        self.used = 0

    def add(self, new: list[bytes]) -> None:
        # in slices, as what a word's rows are made of takes far more room than they do
        parts = [self.make(new[i : i + NEW]) for i in range(0, max(len(new), 1), NEW)]
        made = np.concatenate(parts) if len(parts) > 1 else parts[0]
        need = self.used + len(new)
        if self.values is None or need > len(self.values):
            grown = np.zeros((max(2 * need, 1024), *made.shape[1:]), dtype=made.dtype)
            if self.values is not None:
                grown[: self.used] = self.values[: self.used]
            self.values = grown
        self.values[self.used : need] = made
        self.known.update(zip(new, range(self.used, need), strict=True))
        self.used = need

    def chunks(self, texts: list, encode: Callable[[str], bytes] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, word numbers of texts[begin:end] in order, number of words of each text).

        Words are the longest runs of bytes other than ASCII white space; texts are bytes or null, or
        what ``encode`` makes bytes of, a chunk at a time.  ``values`` holds the rows of these
        numbers until the next chunk is taken.
        """
        for begin, end in spans([len(t or b"") for t in texts], CHUNK):
            words = [(encode(t) if encode else t).split() if t else [] for t in texts[begin:end]]
            if len(self.known) > self.most:
                self.known, self.used = {}, 0
            new = list(set().union(*words).difference(self.known))
            if new or self.values is None:
                self.add(new)
            lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            get = self.known.__getitem__
            ids = np.fromiter((i for w in words for i in map(get, w)), dtype=np.int64, count=int(lens.sum()))
            yield begin, end, ids, lens


def sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values``, ``lens`` rows each; 0 where there are none."""
    out = np.zeros((len(lens), *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(lens)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(lens) - lens)[full], axis=0, dtype=np.float64)
    return out
