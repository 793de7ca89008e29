"""Ranked lexical search, reversed: items are indexed, documents stream through the index.

The texts are read once. A task looks the words of its documents up in the items' vocabulary and keeps, per document, its
length and the counts of these words; this narrow table is written. Document frequencies are sums over it, made on
the executors. A second pass over it sends each document through the inverted index of the items (term -> items that hold
it): the contributions of its terms are added up per item, and the few items whose heap it may enter are updated. A heap holds
`k` documents whatever the data; heaps of all tasks are merged in two steps, so no item's documents meet in one task at once.

Items are dealt with in blocks of bounded size (terms and postings), each with an index of its own, so what is shipped to
the tasks is bounded however many items there are; documents are read once a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, materialize
from .texts import FOLDED, Prefix, pieces, words

#: ASCII other than digits and letters separates terms; all other bytes of UTF-8 belong to one.
TERM_GAP = np.ones(256, bool)
TERM_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Bounds of a block of items. A term has a byte and a gap, so an index has half as many postings (24 bytes each) as bytes of text.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 20_000
#: Cells of (documents x items) that a task adds up at a time.
CELLS = 1 << 21


def term_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, 64-bit hash of every term, row of every term) piece by piece."""
    for lo, hi, data, offsets in pieces(column):
        starts, ends, owner = words(data, offsets, TERM_GAP)
        yield lo, hi, Prefix(data, FOLDED).of(starts, ends), owner


class Index(NamedTuple):
    """Terms of a block of items, sorted; items of term t are items[first[t]:first[t + 1]]."""

    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    size: int


def inverted(texts: list[str | None]) -> Index:
    terms, owners = [], []
    for lo, _, hashes, owner in term_hashes(pa.array(texts, pa.string())):
        terms.append(hashes)
        owners.append(owner + lo)
    pairs = np.unique(np.stack([np.concatenate(terms), np.concatenate(owners).astype(np.uint64)], axis=1), axis=0) if terms else np.zeros((0, 2), np.uint64)
    found, first = np.unique(pairs[:, 0], return_index=True)
    return Index(found, np.append(first, len(pairs)).astype(np.int64), pairs[:, 1].astype(np.int64), len(texts))


COUNTS = "doc_id long, n long, terms array<int>, tf array<int>"


def _counts(index: Index):
    """Length of every document with a term, and how often it holds each term of the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(index.terms)
        for batch in batches:
            for lo, hi, hashes, owner in term_hashes(batch["text"]):
                n = np.bincount(owner, minlength=hi - lo)
                at = np.searchsorted(index.terms, hashes)
                known = np.flatnonzero(index.terms[np.minimum(at, size - 1)] == hashes) if size else np.zeros(0, np.int64)
                cells, tf = np.unique(owner[known] * max(size, 1) + at[known], return_counts=True)
                bounds = np.searchsorted(cells, np.arange(hi - lo + 1) * max(size, 1))
                kept = np.flatnonzero(n > 0)
                ends = np.append(bounds[kept], len(cells)).astype(np.int32)  # documents without terms have no cells
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(lo, hi - lo).take(pa.array(kept)), pa.array(n[kept].astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((cells % max(size, 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))],
                    ["doc_id", "n", "terms", "tf"])

    return run


def _frequencies(size: int):
    """Documents that hold each term, by task; row -1 has the number of documents and of all their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            documents += batch.num_rows
            length += int(batch["n"].to_numpy().sum())
            df += np.bincount(batch["terms"].flatten().to_numpy(), minlength=size)[:size]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({
            "term": pa.array(np.append(-1, held), pa.int32()), "df": pa.array(np.append(documents, df[held]), pa.int64()),
            "length": pa.array(np.append(length, np.zeros(len(held))).astype(np.int64)),
        })

    return run


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def damping(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """How much a document's length holds back its counts: 10 for none, 100 for the mean length."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + 90 * n * documents // length
    return np.array([10 + 90 * v * documents // length for v in n.tolist()], np.int64)


class Heaps:
    """The k best (score, smallest doc_id first, nulls last) per item; at most k entries each."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # what a score must reach to count
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def update(self, item, score, doc, null) -> None:
        item, score, doc, null = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        start = np.searchsorted(item, item)
        rank = np.arange(len(item)) - start
        best = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.item, self.score, self.doc, self.null = item[rank < self.k], score[best], doc[best], null[best]
        self.least[item[rank == self.k - 1]] = score[last]


HEAP = "item int, doc_id long, score long"


def _scored(index: Index, weight: np.ndarray, documents: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(index.size, k)
        many = np.diff(index.first)
        step = max(1, CELLS // max(1, index.size))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ends = np.cumsum(part["terms"].value_lengths().to_numpy(zero_copy_only=False))
                term, tf = part["terms"].flatten().to_numpy().astype(np.int64), part["tf"].flatten().to_numpy().astype(np.int64)
                row = np.searchsorted(ends, np.arange(len(term)), side="right")
                m = damping(part["n"].to_numpy(), documents, length)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                scores = np.zeros(part.num_rows * index.size, np.int64)
                # document by document in runs of so many postings, each added to its item
                runs = np.cumsum(many[term])
                for a, b in _runs(runs, CELLS):
                    each = many[term[a:b]]
                    spread = np.repeat(np.arange(a, b), each)
                    posting = np.arange(len(spread)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(index.first[term[a:b]], each)
                    cell = row[spread] * index.size + index.items[posting]
                    low, high = int(cell.min(initial=0)), int(cell.max(initial=-1)) + 1
                    if high > low:  # sums of doubles are exact: scores stay far below 2^53
                        scores[low:high] += np.bincount(cell - low, weights=value[spread], minlength=high - low).astype(np.int64)
                table = scores.reshape(part.num_rows, index.size)
                doc, item = np.nonzero(table >= heaps.least)
                if len(doc):
                    ids = part["doc_id"]
                    heaps.update(item, table[doc, item], ids.fill_null(0).to_numpy()[doc], ids.is_null().to_numpy(zero_copy_only=False)[doc])
        if len(heaps.item):
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(heaps.item, pa.int32()), "doc_id": pa.array(heaps.doc, pa.int64(), mask=heaps.null), "score": pa.array(heaps.score)})

    return run


def _runs(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `limit`, given running totals."""
    a, done = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield a, b
        a, done = b, int(ends[b - 1])


def _best(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their rank; a first step over parts of each item keeps every group small."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = heaps.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items in runs of bounded number and text; only a single longer item goes beyond the bound."""
    block, held = [], 0
    for r in items.toLocalIterator():
        cost = len((r["text"] or "").encode())
        if block and (held + cost > BLOCK_BYTES or len(block) == BLOCK_ITEMS):
            yield block
            block, held = [], 0
        block.append(r)
        held += cost
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_key: str = "item_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item; scores above 0 only, ties by ascending doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z, as 64-bit hashes. Null,
    empty and termless texts score nothing and do not count as documents. Repeated documents are ranked one by one, a null
    doc_id after others of its score. Repeated items (equal id and text) are one item; items of one id with different texts are
    ranked each on its own. Texts are never cut. Other columns are ignored; without documents or items there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = materialize(items.select(F.col(item_key).cast("long").alias("item_id"), F.col(text).alias("text")).distinct(), "items")
    found: DataFrame | None = None
    for block in _blocks(wanted):
        index = inverted([r["text"] for r in block])
        size = len(index.terms)
        if not size:
            continue
        counts = materialize(rows.mapInArrow(_counts(index), COUNTS), "term-counts")
        sums = counts.select("n", "terms").mapInArrow(_frequencies(size), "term int, df long, length long")
        known = {r["term"]: (r["df"], r["length"]) for r in sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).collect()}
        documents, length = known.pop(-1, (0, 0))
        df = np.zeros(size, np.int64)
        for term, (number, _) in known.items():
            df[term] = number
        if documents:
            ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item int, item_id long")
            heaps = counts.mapInArrow(_scored(index, weights(documents, df), documents, length, k), HEAP)
            best = materialize(_best(heaps, k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "best")
            found = best if found is None else found.union(best)
        discard(counts)
    discard(wanted)
    return found if found is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
