"""BPE encoding and decoding by tree concatenation.

A long text is cut into halves of halves before it is split, wherever the cuts fall.  The leaves
of all texts are split and encoded together, and joined upwards: a growing window around each
join is split and encoded again until it agrees with both sides.  A pre-token that spans a cut is
joined alike, from the tokens of its two parts.  Ids are packed as little-endian unsigned 32-bit
integers, the usual form of token files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import LEAF, Vocabulary, vocabulary
from .common import spans

#: Pre-tokens that a worker remembers, characters worked on and given out at a time, and
#: characters of a leaf.
REMEMBERED, CHARS, LEAF_CHARS = 100_000, 2_000_000, 1024


def halves(text: str, leaf: int) -> list[str]:
    """The text's leaves: halves of halves until none is longer than ``leaf``; none for no text."""
    parts = 1 << max(0, -(-len(text) // leaf) - 1).bit_length()
    return [x for i in range(parts) if (x := text[len(text) * i // parts : len(text) * (i + 1) // parts])]


class Encoder:
    """Encodes texts by the tree, remembering the tokens of pre-tokens up to a bound; counts joins."""

    def __init__(self, vocab: Vocabulary, leaf: int = LEAF_CHARS) -> None:
        self.vocab, self.leaf, self.joins = vocab, leaf, 0
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str], parts: dict[str, tuple[str, str]]) -> None:
        """Tokens of new pre-tokens: of long ones that join two known parts, from those."""
        new = list(pieces.difference(self.known))
        long = [p for p in new if p in parts and len(p) > 2 * LEAF]
        sides = [tuple(np.frombuffer(self.known[x], dtype="<u4").astype(np.int32) for x in parts[p]) for p in long]
        rest = [p for p in new if p not in parts or len(p) <= 2 * LEAF]
        ids = [*self.vocab.join_ids(sides), *self.vocab.encode_pieces(rest)]
        self.known.update(zip([*long, *rest], (i.astype("<u4").tobytes() for i in ids), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for begin, end in spans([len(t or "") for t in texts], CHARS):
            level = [[self.vocab.pieces(x) for x in halves(t or "", self.leaf)] for t in texts[begin:end]]
            self._learn(set().union(*(p for doc in level for p in doc)), {})
            high = [i for i, doc in enumerate(level) if len(doc) > 1]
            while high:
                fresh: set[str] = set()
                parts: dict[str, tuple[str, str]] = {}
                for i in high:
                    up, doc = [], level[i]
                    for left, right in zip(doc[::2], doc[1::2], strict=False):
                        both, window = self.vocab.join_pieces(left, right)
                        fresh.update(window)
                        parts[left[-1] + right[0]] = left[-1], right[0]
                        up.append(both)
                        self.joins += 1
                    level[i] = up + doc[len(up) * 2 :]
                self._learn(fresh, parts)
                high = [i for i in high if len(level[i]) > 1]
            out += [b"".join(map(self.known.__getitem__, doc[0])) if doc else b"" for doc in level]
            if len(self.known) > REMEMBERED:
                self.known.clear()
        return out


def decode_ids(vocab: Vocabulary, packed: bytes | None) -> str:
    """The text of packed ids; bytes that are not UTF-8 become U+FFFD.  Unknown ids are an error."""
    ids = np.frombuffer(packed or b"", dtype="<u4").tolist()
    return vocab.bytes_of(ids).decode("utf-8", "replace")


def encoded(text: Column, path: str) -> Column:
    """Packed ids (binary) of each whole text."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            yield pd.Series(encoder.encode(batch.tolist()), dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of each row of packed ids."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pd.Series([decode_ids(vocab, x) for x in batch.tolist()], dtype=object)

    return decode(ids)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (packed, binary), decoded (string).

    Whole texts are encoded without added special tokens; special strings inside a text become
    their own id.  ``decoded`` is made from the ids alone, in the same pass over the rows.  A
    null text counts as empty and gives empty ids and an empty string.  Repeated rows stay, a
    null id stays null, an empty table gives no rows; other columns are not read or returned.
    """

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for batch in batches:
            texts = batch.tolist()
            for begin, end in spans([len(t or "") for t in texts], CHARS):
                ids = encoder.encode(texts[begin:end])
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([decode_ids(vocab, x) for x in ids], dtype=object)})

    return docs.select(F.col(doc_id).alias("doc_id"), both(F.col(text)).alias("_codec")).select("doc_id", "_codec.*")


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, columns named in ``more``, and SHA-256 of packed ids and decoded text."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        *more,
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
