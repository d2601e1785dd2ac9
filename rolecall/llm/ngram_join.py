"""N-gram Jaccard join by MinHash banding.

Texts with equal n-gram sets form one class, and only one text of each class takes part.  Band
and row counts are chosen for a target recall at the threshold.  Classes meet where a band of
their signatures agrees; a pair belongs to the first band that it shares, so each is looked at
once, and it is verified on the full n-gram sets.  Large buckets are dealt in blocks, bounded by
classes and by grams, that meet pairwise; from each cell come sums and a spanning forest, never
the pairs.  Texts are read again only for the classes that have a pair to verify, one text for
each class, and what the cells get is its gram hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, marked, row_hash, text_hash, written
from .words import WordTable

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


@dataclass(frozen=True)
class JoinParams:
    """``n`` words a gram; pairs of ``threshold`` or more are links, found with probability
    ``recall`` or more; at most ``hashes`` MinHash values; blocks of about ``block`` classes and
    ``block_grams`` grams (eight bytes each) at most, but that a single text may hold more."""

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    hashes: int = 150
    block: int = 1024
    block_grams: int = 1_000_000

    @property
    def bands_rows(self) -> tuple[int, int]:
        """The most rows a band for which enough bands fit."""
        best = None
        for rows in range(1, self.hashes + 1):
            p = self.threshold**rows
            bands = 1 if p >= 1 else math.ceil(math.log(1 - self.recall) / math.log1p(-p))
            if bands * rows <= self.hashes:
                best = bands, rows
        if best is None:
            raise ValueError("no banding within this many hashes reaches the recall")
        return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def gram_sets(texts: list[bytes | None], table: WordTable, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, sorted distinct gram hashes of each text in a row, how many each has).

    A text of fewer than ``n`` words, but at least one, has all its words as its only gram.
    """
    for begin, end, ids, lens in table.chunks(texts):
        words = table.values[ids]
        docs = end - begin
        grams = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
        doc = np.repeat(np.arange(docs), grams)
        start = np.cumsum(lens) - lens
        at = np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams) + start[doc]
        code = np.zeros(len(doc), dtype=np.uint64)
        for k in range(n):
            inside = k < lens[doc]
            code = code * _ODD[0] + np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))] + np.uint64(1), np.uint64(0)) if len(doc) else code
        code = _mix(code)
        order = np.lexsort((code, doc))
        code, doc = code[order], doc[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        yield begin, end, code[new], np.bincount(doc[new], minlength=docs)


def signatures(grams: np.ndarray, counts: np.ndarray, params: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set [d, 2] and its band hashes [d, bands]; zeros for an empty set."""
    bands, rows = params.bands_rows
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    sums, out = np.zeros((len(counts), 2), dtype=np.uint64), np.zeros((len(counts), bands), dtype=np.uint64)
    if len(full):
        for k in range(2):
            sums[full, k] = np.add.reduceat(_mix(grams + _ODD[3 + k]), starts)
        seeds = np.random.default_rng(20).integers(1, 2**63, size=(bands, rows, 2), dtype=np.uint64)
        for b in range(bands):
            code = np.full(len(full), b + 1, dtype=np.uint64)
            for r in range(rows):
                least = np.minimum.reduceat(grams * (seeds[b, r, 0] | np.uint64(1)) + seeds[b, r, 1], starts)
                code = _mix(code * _ODD[1] + least)
            out[full, b] = code
    return sums, out


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, and hashes of the text and of the whole row."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"), row_hash(docs).alias("row_hash"))


def _signed(rows: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, text_hash, row_hash, n (grams), set_key (a hash of the gram set), bands of each row;
    n is 0 without words or id."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(_word_hashes)
        for batch in batches:
            ids = batch["doc_id"]
            texts = [t.encode() if t is not None and ok else None for t, ok in zip(batch["text"], ids.notna(), strict=True)]
            for begin, end, grams, counts in gram_sets(texts, table, params.n):
                sums, bands = signatures(grams, counts, params)
                part = {c: batch[c].iloc[begin:end].to_numpy() for c in ("text_hash", "row_hash")}
                yield pd.DataFrame({"doc_id": ids[begin:end].astype("Int64").to_numpy(), **part, "n": counts.astype(np.int32), "set_key": _keys(sums), "bands": list(bands.view(np.int64))})

    return rows.mapInPandas(sign, "doc_id long, text_hash long, row_hash long, n int, set_key binary, bands array<long>")


def _keys(sums: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in sums]


def _sets(texts: DataFrame, params: JoinParams) -> DataFrame:
    """set_key and grams (packed) of each row's text."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(_word_hashes)
        for batch in batches:
            for _, _, grams, counts in gram_sets([t.encode() for t in batch["text"]], table, params.n):
                sums, _ = signatures(grams, counts, JoinParams(params.n, 1.0, 0.5, 1))
                yield pd.DataFrame({"set_key": _keys(sums), "grams": [g.tobytes() for g in np.split(grams, np.cumsum(counts)[:-1])]})

    return texts.select("text").mapInPandas(make, "set_key binary, grams binary")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole cells, from batches sorted by cell."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        cells = [batch[c].to_numpy() for c in ("key", "low", "high")]
        last = np.logical_and.reduce([c == c[-1] for c in cells])
        ends = int(last.argmax())  # rows of the batch's last cell begin here
        if rest and not all(rest[-1][c].iloc[-1] == batch[c].iloc[0] for c in ("key", "low", "high")):
            yield pd.concat(rest, ignore_index=True)
            rest = []
        if ends:
            yield pd.concat([*rest, batch.iloc[:ends]], ignore_index=True)
            rest = []
        rest.append(batch.iloc[ends:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


class _Pairs:
    """The pairs of rows of each cell that may be links and share no earlier band."""

    def __init__(self, rows: pd.DataFrame, threshold: float) -> None:
        self.bands, self.n = np.stack(rows["bands"].to_numpy()), rows["n"].to_numpy()
        self.block, self.pos = rows["part"].to_numpy(), rows["pos"].to_numpy()
        self.across = rows["low"].to_numpy() != rows["high"].to_numpy()
        cell = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("key", "low", "high")])
        self.fresh = np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)]
        self.cell, self.threshold = np.cumsum(self.fresh) - 1, threshold

    def by_offset(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.bincount(self.cell)
        for d in range(1, int(sizes.max())):
            i = np.flatnonzero(self.cell[d:] == self.cell[:-d])
            j = i + d
            ok = (np.minimum(self.n[i], self.n[j]) >= self.threshold * np.maximum(self.n[i], self.n[j])) & (~self.across[i] | (self.block[i] != self.block[j]))
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 20_000):
                a, b = i[at : at + 20_000], j[at : at + 20_000]
                first = (self.bands[a] == self.bands[b]).argmax(axis=1)
                mine = first == self.pos[a]
                if mine.any():
                    yield a[mine], b[mine]


def _needed(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows that have a pair to verify in their cell."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _cells(batches):
            need = np.zeros(len(part), dtype=bool)
            for i, j in _Pairs(part, threshold).by_offset():
                need[i] = need[j] = True
            yield part[need]

    return rows.mapInPandas(find, rows.schema)


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted distinct arrays."""
    out = np.zeros(len(i), dtype=np.int64)
    members = np.unique(np.r_[i, j])
    if len(i) <= 4 * len(members):
        for k, (a, b) in enumerate(zip(i, j, strict=True)):
            both = np.sort(np.concatenate([sets[a], sets[b]]), kind="stable")
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        return out
    # many pairs of few sets: products of 0/1 matrices, a slice of the grams at a time
    flat = np.concatenate([sets[m] for m in members])
    _, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = 4096
    total = np.zeros((len(members), len(members)), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1, width):
        s, e = np.searchsorted(column, [low, low + width])
        here = np.zeros((len(members), width), dtype=np.float32)
        here[row[s:e], column[s:e] - low] = 1
        total += here @ here.T
    return total[np.searchsorted(members, i), np.searchsorted(members, j)].astype(np.int64)


def _trees(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component under the pairs: least labels, then labels of labels."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _verified(rows: DataFrame, params: JoinParams) -> DataFrame:
    """set_key, root (of its tree in the cell's forest) and links (copies of all it is linked to)."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _cells(batches):
            sets = [np.frombuffer(g, dtype=np.uint64) for g in part["grams"]]
            pairs, copies, key = _Pairs(part, params.threshold), part["copies"].to_numpy(), part["set_key"].to_numpy()
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for i, j in pairs.by_offset():
                for c in np.unique(pairs.cell[i]):
                    ok = pairs.cell[i] == c
                    found.setdefault(int(c), []).append((i[ok], j[ok]))
            links, linked_i, linked_j = np.zeros(len(part), dtype=np.int64), [], []
            for chunks in found.values():
                i, j = np.concatenate([a for a, _ in chunks]), np.concatenate([b for _, b in chunks])
                common = _common(sets, i, j)
                # integers on both sides but for the threshold; a gram set's sizes are far below 2^53
                linked = common >= params.threshold * (pairs.n[i] + pairs.n[j] - common) - 1e-9
                i, j = i[linked], j[linked]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                linked_i.append(i)
                linked_j.append(j)
            if not linked_i:
                continue
            root = _trees(len(part), np.concatenate(linked_i), np.concatenate(linked_j))
            keep = np.flatnonzero(links)
            yield pd.DataFrame({"set_key": key[keep], "root": key[root[keep]], "links": links[keep]})

    return rows.mapInPandas(verify, "set_key binary, root binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of undirected ``edges`` (a, b).

    Nodes are of any type with an order; edges of a node to itself and repeated ones say nothing,
    and edges with a null end are left out; no edges give no rows.  Least labels spread along
    edges and jump along labels until nothing changes; each round is written to the shared folder.
    """
    both = written(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")), "labels-low")
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = written(lower.join(jump, "low").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if not new.where("changed").limit(1).count():
            return labels


def _judged(rows: DataFrame, params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and one line per class of equal gram sets: set_key, least (doc_id,
    text_hash, row_hash of its first row), copies, group (of linked classes), links."""
    signed = written(_signed(rows, params), "signatures")
    classes = written(
        signed.where("n > 0").groupBy("set_key", "n").agg(F.min(F.struct("doc_id", "text_hash", "row_hash")).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands")),
        "classes",
    )
    spread = classes.select("set_key", "n", F.posexplode("bands").alias("pos", "key"))
    shared = written(
        spread.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.lit(1 / params.block) + F.col("n") / params.block_grams).alias("load")).where("members > 1").select("key", F.ceil("load").cast("int").alias("parts")),
        "buckets",
    )
    members = marked(spread.select("set_key", "pos", "key"), "maybe", F.col("key"), shared, F.col("key")).where("maybe").join(shared, "key").join(classes.select("set_key", "n", "copies", "bands"), "set_key")
    cells = (
        members.withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("part", "_other").alias("low"), F.greatest("part", "_other").alias("high"), "pos", "part", "set_key", "n", "copies", "bands")
    )
    order = ["key", "low", "high"]
    need = written(_needed(cells.repartition(*order).sortWithinPartitions(*order, "set_key"), params.threshold), "to-verify")
    # one text for each class that has a pair: that of its least row
    wanted = written(need.select("set_key").distinct().join(classes, "set_key").select(F.col("least.doc_id").alias("doc_id"), F.col("least.text_hash").alias("text_hash")).distinct(), "texts-wanted")
    maybe = marked(rows.select("doc_id", "text_hash", "text").where("text is not null"), "maybe", F.col("text_hash"), wanted, F.col("text_hash")).where("maybe").drop("maybe")
    texts = maybe.join(wanted, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    sets = written(_sets(texts, params), "gram-sets")
    found = written(_verified(need.join(sets, "set_key").repartition(*order).sortWithinPartitions(*order, "set_key"), params), "verified")
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("set_key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("set_key"), "label")
    lines = classes.select("set_key", "least", "copies").join(links, "set_key", "left").join(labels, "set_key", "left")
    return signed, written(lines.select("set_key", "least", "copies", F.coalesce("label", "set_key").alias("group"), F.coalesce("links", F.lit(0)).alias("links")), "classes-judged")


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is
    ``threshold`` or more (equal sets always are; a text shorter than n words is one gram).
    ``n_links`` counts the other rows that a document is linked to, copies included, and
    ``class_id`` is the least doc_id of those it is connected with by links.  A document without
    words (null or white space) or with a null id is linked to none: class_id is its doc_id and
    n_links 0.  Repeated rows are copies of each other.  Each row is judged by its own text, so
    rows that share an id but not a text are documents of their own.  An empty table gives no
    rows; other columns are neither compared nor returned.
    """
    signed, classes = _judged(_rows(docs, doc_id, text), params)
    groups = classes.groupBy("group").agg(F.min("least.doc_id").alias("class_id"))
    named = written(classes.join(groups, "group").select("set_key", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")), "classes-named")
    return (
        signed.select("doc_id", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"))
        .join(named, "set_key", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def keep_one(docs: DataFrame, params: JoinParams = JoinParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the least id.

    Rows are told apart by id, text and the hash of all columns, in this order: where an id comes
    with two texts, each is kept or dropped by its own text, and of exactly repeated rows one
    stays.  Rows without words (null or white space) or with a null id are in no group and all
    stay.  An empty table gives no rows.  Any further columns, whatever their names, are kept;
    rows that differ only in columns that can't be hashed (maps) count as repeated.  Ids are whole
    numbers (a text that is none is an error).
    """
    signed, classes = _judged(_rows(docs, doc_id, text), params)
    triple = F.struct("doc_id", "text_hash", "row_hash")
    stays = written(classes.groupBy("group").agg(F.min("least").alias("least")).select("least.*"), "rows-kept")
    in_class = signed.where("n > 0").groupBy("doc_id", "text_hash", "row_hash").agg(F.count("*").alias("times"))
    keys = ["doc_id", "text_hash", "row_hash"]
    gone = written(in_class.join(stays, keys, "left_anti").select(keys), "rows-dropped")
    again = written(in_class.where("times > 1").join(stays, keys, "left_semi").select(keys), "rows-repeated")
    key, maybe = free_names(docs, "_row", "_maybe")
    rows = docs.withColumn(key, F.struct(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("text_hash"), row_hash(docs).alias("row_hash")))
    listed = lambda table: table.select(triple.alias(key))
    rows = marked(rows, maybe, F.col(key)["text_hash"], gone.unionAll(again), F.col("text_hash"))
    sure, asked = rows.where(~F.col(maybe)), rows.where(maybe)
    left = asked.join(listed(gone.unionAll(again)), key, "left_anti")
    return sure.unionByName(left).unionByName(asked.join(listed(again), key, "left_semi").dropDuplicates([key])).drop(key, maybe)


def oracle_sql() -> str:
    """``near_duplicates`` of documents as DuckDB SQL, by all pairs that share a gram."""
    return r"""
    WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    grams AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM docs WHERE len(w) > 0 AND doc_id IS NOT NULL)),
    sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
    pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
    ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached AS (SELECT x AS r, x AS root FROM (SELECT DISTINCT x FROM ends) UNION SELECT b.y, root FROM reached JOIN ends b ON b.x = reached.r),
    classes AS (SELECT reached.r, min(d.doc_id) AS class_id FROM reached JOIN docs d ON d.r = root GROUP BY ALL),
    counts AS (SELECT x AS r, count(*) AS n_links FROM ends GROUP BY x)
    SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM docs LEFT JOIN classes USING (r) LEFT JOIN counts USING (r)
    """
