"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as ragged numpy arrays; each round merges every sequence's
lowest-rank pair at once, and the surviving symbols are counted.  A pre-token is merged once
for each Python worker and remembered up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import spans

#: Pre-tokens that a worker remembers, and characters worked on at a time.
REMEMBERED, CHARS = 150_000, 2_000_000


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of each whole text under the vocabulary file ``path`` (read on executors)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab, known = vocabulary(path), {}
        for batch in batches:
            texts = batch.tolist()
            found: list[int] = []
            for begin, end in spans([len(t or "") for t in texts], CHARS):
                pieces = [vocab.pieces(t) if t else [] for t in texts[begin:end]]
                new = list(set().union(*pieces).difference(known))
                known.update(zip(new, map(len, vocab.encode_pieces(new)), strict=True))
                found += [sum(map(known.__getitem__, p)) for p in pieces]
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.Series(found, dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Whole texts count, of any length.  A null or empty text has 0 bytes and 0 tokens.  Special
    strings inside a text are one token each, as the tokenizers library has it by default; no
    other special tokens are added.  Repeated rows stay as they are, a null id stays null, an
    empty table gives no rows, and other columns of ``docs`` are not read or returned.
    """
    body = F.col(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(body).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
        token_count(body, path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
