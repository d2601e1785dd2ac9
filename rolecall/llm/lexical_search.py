"""Ranked lexical search by dense blocked matrix products.

Items (queries) go in blocks.  A block's distinct terms form a compact vocabulary; one pass over the
documents keeps, of each, its number of terms and the counts of those of the vocabulary.  Scoring
multiplies tiles of document impacts with tiles of item weights in float64.  All factors are whole
numbers, and a vocabulary tile ends before its sums could reach 2^53, so every partial sum is exact;
tiles are added up as 64-bit integers.  Each task keeps the best of every item by (score, id) over its
tiles, ties included, and what tasks kept is ranked in two levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spans, written
from .words import CHUNK

#: Bytes that are no part of a term become spaces, A-Z their lower case; others stay.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
EXACT = 1 << 53
#: An impact is below this, whatever the counts.
MOST_IMPACT = 1_000_000


@dataclass(frozen=True)
class SearchParams:
    """The ``k`` best of each item.  A block of items has about ``block_items`` items and
    ``block_terms`` terms; tiles are ``tile_docs`` documents by ``tile_terms`` terms.  What tasks
    kept is ranked first in ``salts`` parts."""

    k: int = 50
    block_items: int = 256
    block_terms: int = 20_000
    tile_docs: int = 1024
    tile_terms: int = 2048
    salts: int = 16


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order; none for null."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id and term, one row for each distinct term of an item (rows of one id are one item)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch["text"]]
            ids = batch["item_id"].astype("Int64").repeat(list(map(len, found))).reset_index(drop=True)
            yield pd.DataFrame({"item_id": ids, "term": np.array([x.decode() for f in found for x in f], dtype=object)})

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return written(rows.mapInPandas(split, "item_id long, term string").distinct(), "search-items")


def _matched(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms (sorted numbers of the vocabulary's), tf; documents without a term are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        width = max(1, len(vocabulary))
        for batch in batches:
            texts = batch["text"].tolist()
            for begin, end in spans([len(t or "") for t in texts], CHUNK):
                words = [terms(t) for t in texts[begin:end]]
                lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                ids = np.fromiter((get(w, -1) for ws in words for w in ws), dtype=np.int64, count=int(lens.sum()))
                doc = np.repeat(np.arange(len(words)), lens)
                hit = ids >= 0
                key, tf = np.unique(doc[hit] * width + ids[hit], return_counts=True)
                cut = np.searchsorted(key, np.arange(1, len(words)) * width)
                out = pd.DataFrame({"doc_id": batch["doc_id"].iloc[begin:end].astype("Int64").to_numpy(), "n": lens, "terms": np.split((key % width).astype(np.int32), cut), "tf": np.split(tf.astype(np.int32), cut)})
                yield out[lens > 0]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "doc_id long, n long, terms array<int>, tf array<int>")


def tiles(weights: np.ndarray, most_terms: int) -> list[tuple[int, int]]:
    """Spans of the vocabulary whose sums stay below 2^53, whatever the impacts."""
    out, begin, total = [], 0, 0
    for i, w in enumerate(weights.tolist()):
        if i > begin and (i - begin == most_terms or total + w * MOST_IMPACT >= EXACT):
            out.append((begin, i))
            begin, total = i, 0
        total += w * MOST_IMPACT
    return [*out, (begin, len(weights))] if len(weights) else []


class Best:
    """The ``k`` best (score, id) of each item so far; a null id comes after all others."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(n_items, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores [documents, items]: all that reach an item's floor, so no tie is lost."""
        doc, item = np.nonzero(scores >= self.floor)
        self.parts.append((item, scores[doc, item], ids[doc], null[doc]))
        self.held += len(doc)
        if self.held > 4 * self.k * len(self.floor):
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.astype(bool)
        item, score, ids, null = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(item)) - np.repeat(begin, np.diff(np.r_[begin, len(item)]))
        self.floor[item[rank == self.k - 1]] = score[rank == self.k - 1]
        keep = rank < self.k
        self.parts = [(item[keep], score[keep], ids[keep], null[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def _scored(matched: DataFrame, item_ids: list[int | None], owners: np.ndarray, columns: np.ndarray, weights: np.ndarray, n_docs: int, total: int, params: SearchParams) -> DataFrame:
    """item_id, doc_id, score: the best of each task.  ``owners`` and ``columns`` are the (item, term) pairs, sorted by term."""
    cuts = tiles(weights, params.tile_terms)
    names = np.array([-1 if i is None else i for i in item_ids], dtype=np.int64)
    no_name = np.array([i is None for i in item_ids], dtype=bool)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(item_ids), params.k)
        for batch in batches:
            for at in range(0, len(batch), params.tile_docs):
                part = batch.iloc[at : at + params.tile_docs]
                lens = part["terms"].map(len).to_numpy()
                if not lens.sum():
                    continue
                doc = np.repeat(np.arange(len(part)), lens)
                term, tf = np.concatenate(part["terms"].tolist()), np.concatenate(part["tf"].tolist()).astype(np.int64)
                m = 50 + (50 * part["n"].to_numpy(dtype=np.int64) * n_docs) // total
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
                scores = np.zeros((len(part), len(item_ids)), dtype=np.int64)
                for low, high in cuts:
                    has = (term >= low) & (term < high)
                    if not has.any():
                        continue
                    a, b = np.searchsorted(columns, (low, high))
                    left, right = np.zeros((len(part), high - low)), np.zeros((high - low, len(item_ids)))
                    left[doc[has], term[has] - low] = impact[has]
                    right[columns[a:b] - low, owners[a:b]] = weights[columns[a:b]]
                    scores += (left @ right).astype(np.int64)
                ids = part["doc_id"].astype("Int64")
                best.add(scores, ids.fillna(0).to_numpy(dtype=np.int64), ids.isna().to_numpy())
        item, score, ids, null = best.prune()
        out = pd.DataFrame({"item_id": names[item], "doc_id": ids, "score": score}).astype({"item_id": "Int64", "doc_id": "Int64"})
        out.loc[no_name[item], "item_id"] = pd.NA
        out.loc[null, "doc_id"] = pd.NA
        yield out

    return matched.mapInPandas(search, "item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, params: SearchParams = SearchParams(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` best documents with a score above 0.

    Equal scores go by ascending doc_id, a null id last; repeated rows of documents are documents of
    their own.  Null and empty texts, and texts without a term, are no documents, and items without
    a term, or whose terms are in no document, get no rows.  Rows of one item_id (null counts as one)
    are one item with the terms of all; a term counts once.  Ids are whole numbers.  Empty tables
    give no rows; other columns are neither read nor returned.  The driver holds one block of items.
    """
    spark = docs.sparkSession
    pairs = _item_terms(items, item_id, item_text)
    size = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.struct("item_id")).alias("items")).first()
    blocks = max(1, math.ceil(size["items"] / params.block_items), math.ceil(size["pairs"] / params.block_terms))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks if size["pairs"] else 0):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()
        if not len(rows):
            continue
        vocabulary = {t.encode(): i for i, t in enumerate(sorted(set(rows["term"])))}
        item_ids = [None if pd.isna(i) else int(i) for i in rows["item_id"].unique()]
        place = {i: k for k, i in enumerate(item_ids)}
        owners = np.array([place[None if pd.isna(i) else int(i)] for i in rows["item_id"]], dtype=np.int64)
        columns = np.array([vocabulary[t.encode()] for t in rows["term"]], dtype=np.int64)
        order = np.argsort(columns, kind="stable")
        matched = written(_matched(docs, vocabulary, doc_id, text), "search-matched")
        totals = matched.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not totals["n"]:
            break
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in matched.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weights = np.array([weight(totals["n"], int(d)) for d in df], dtype=np.int64)
        best = _scored(matched.where(F.size("terms") > 0), item_ids, owners[order], columns[order], weights, totals["n"], totals["l"], params)
        out = out.unionAll(written(best, "search-best") if blocks > 1 else best)
    order_by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    within = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(params.salts))).orderBy(*order_by)
    some = out.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= params.k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order_by)))
    return ranked.where(F.col("rank") <= params.k).select("item_id", "rank", "doc_id", "score")


def oracle_sql() -> str:
    return r"""
with pattern as (select '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' as p),
 words as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) as term from documents, pattern),
 tfs as (select doc_id, term, count(*) as tf from words group by all),
 lens as (select doc_id, sum(tf)::bigint as n from tfs group by all),
 total as (select count(*) as nn, sum(n)::bigint as ll from lens),
 items as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)) as term from benchmark, pattern),
 weights as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs, total where term in (select term from items) group by term, nn),
 scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from items join weights using (term) join tfs using (term) join lens using (doc_id), total group by all)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 50"""
