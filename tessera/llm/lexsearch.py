"""Ranked lexical search the other way round: documents stream through an inverted
index over the queries ("items").

The items are few against the documents, so their terms, not the documents', are
indexed: term to (item, times). The first pass finds each document's counts of
the index's terms, in one read of the texts, and stores them as numbers; Spark
sums document frequencies, N and L over all documents. In the second pass each
document's counts stream through the index, scores add up in integers, and a heap
of ``k`` entries for each item keeps the best so far. The tasks' heaps are merged in
two steps, first among groups of tasks.

An index is broadcast, so items are taken in blocks of BLOCK_BYTES of text; each
block costs one read of the documents. Nothing of the documents is broadcast or
collected but N, L and the frequencies of a block's terms.

Defined results: null or empty texts have no terms; such an item gives no rows
and such a document is not counted in N. Rows that repeat an item_id are items
each, documents that repeat a doc_id are ranked each. Equal scores rank by doc_id,
a null doc_id first. Texts of any length count whole. Other columns are ignored.
Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoded, id_out, id_text, rows, schema_of, stored

#: Bytes of item texts in one index, which every executor gets.
BLOCK_BYTES = 4 << 20
#: Scores (documents x items) that a task holds at once.
CELLS = 1 << 21
#: Groups of tasks whose heaps are merged first.
GROUPS = 64
#: Letters and digits of ASCII, lower-cased, and all bytes above; others end a term.
_TERM = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ItemIndex:
    """term number to (item, times) pairs of the items that hold it."""

    def __init__(self, texts: list[bytes]):
        self.numbers: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for item, t in enumerate(texts):
            for term, times in Counter(terms(t)).items():
                if (k := self.numbers.setdefault(term, len(postings) + 1)) > len(postings):
                    postings.append([])
                postings[k - 1].append((item, times))
        flat = [p for ps in postings for p in ps]
        self.items, self.times = (np.array([p[j] for p in flat], np.int64) for j in (0, 1))
        self.sizes = np.array([len(ps) for ps in postings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes


_COUNTS = "doc_ids array<long>, lengths array<long>, sizes array<int>, terms array<int>, counts array<int>"


def term_counts(own: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """A row for each batch of documents with terms: their ids and numbers of
    terms, and of each the index's terms (from 1) with their counts."""
    out = schema_of(_COUNTS.replace(", ", ","))
    sent = own.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, top = sent.value.get, len(sent.value) + 1
        for b in batches:
            ids, lengths, hits, of = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), encoded(b.column(1))):
                if words := terms(t):
                    ids.append(i)
                    lengths.append(len(words))
                    hits.append(np.fromiter(filter(None, map(get, words)), np.int64))
            if ids:
                of = np.repeat(np.arange(len(ids)), [len(h) for h in hits])
                pair, n = np.unique(of * top + np.concatenate(hits), return_counts=True)
                sizes = np.bincount(pair // top, minlength=len(ids))
                yield rows(out, [ids], [lengths], [sizes], [pair % top], [n])

    return own.mapInArrow(count, _COUNTS)


class Heaps:
    """The best ``k`` (score, doc_id) of each item, the least doc_id first among equals."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.low = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def update(self, scores: np.ndarray, doc_ids: list[int]) -> None:
        """scores: documents x items."""
        low = self.low
        if len(doc_ids) > self.k:
            low = np.maximum(low, np.partition(scores, len(doc_ids) - self.k, axis=0)[len(doc_ids) - self.k])
        at, items = np.nonzero(scores >= low)
        for d, item, s in zip(at.tolist(), items.tolist(), scores[at, items].tolist()):
            heap, entry = self.heaps[item], (s, -doc_ids[d])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.low[item] = heap[0][0]

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        return ((item, -d, s) for item, heap in enumerate(self.heaps) for s, d in heap)


def score_block(index: ItemIndex, weights: np.ndarray, n_docs: int, n_terms: int, lengths: np.ndarray, sizes: np.ndarray, found: np.ndarray, counts: np.ndarray, n_items: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, scores of documents x items) of a few documents at a time."""
    m = 75 + 25 * lengths * n_docs // n_terms
    doc, tf, term = np.repeat(np.arange(len(sizes)), sizes), counts.astype(np.int64), found.astype(np.int64) - 1
    part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    ends, step = np.cumsum(sizes), max(1, CELLS // max(1, n_items))
    # Fewer where documents hold common terms: an update for each posting.
    work = np.cumsum(index.sizes[term])
    a = 0
    while a < len(sizes):
        x = ends[a - 1] if a else 0
        done = work[x - 1] if x else 0
        b = min(a + step, max(a + 1, int(np.searchsorted(work[ends - 1], done + 4 * CELLS, "right")))) if len(work) else a + step
        b = min(b, len(sizes))
        y = ends[b - 1]
        n = index.sizes[term[x:y]]
        at = np.arange(n.sum()) + np.repeat(index.starts[term[x:y]] - np.cumsum(n) + n, n)
        scores = np.zeros((b - a) * n_items, np.int64)
        np.add.at(scores, np.repeat(doc[x:y] - a, n) * n_items + index.items[at], np.repeat(part[x:y], n) * index.times[at])
        yield a, scores.reshape(b - a, n_items)
        a = b


def _best(counts: DataFrame, texts: list[bytes], k: int) -> DataFrame:
    """(item, doc_id, score): the tasks' heaps over the documents of ``counts``."""
    spark = counts.sparkSession
    index = ItemIndex(texts)
    total = counts.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).cast("long"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    n_docs, n_terms = total
    df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(1, len(index.sizes) + 1)], np.int64)
    sent = spark.sparkContext.broadcast((index.items, index.times, index.sizes, index.starts, weights))
    ddl, n_items = "item long, doc_id long, score long, part long", len(texts)
    out = schema_of(ddl.replace(", ", ","))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ItemIndex([])
        own.items, own.times, own.sizes, own.starts, w = sent.value
        heaps = Heaps(n_items, k)
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths, sizes, found, tf = (b.column(c)[i].values.to_numpy() for c in range(5))
                for a, scores in score_block(own, w, n_docs, n_terms, lengths, sizes, found, tf, n_items):
                    heaps.update(scores, ids[a : a + len(scores)].tolist())
        part = TaskContext.get().partitionId()
        yield rows(out, *(list(zip(*((*x, part) for x in heaps))) or [[]] * 4))

    return counts.mapInArrow(search, ddl)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents (doc_id, text) of the
    highest score above 0 for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    ddl = "item_id long, rank int, doc_id long, score long"
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    blocks = (asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // block_bytes + 1
    own, got = id_text(docs), spark.createDataFrame([], ddl)
    for n in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()
        if not mine:
            continue
        texts = [r["text"].encode() for r in mine]
        counts = stored(term_counts(own, ItemIndex(texts).numbers), "counts", "zstd")
        order = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
        heaps = _best(counts, texts, k).withColumn("group", F.pmod("part", F.lit(GROUPS)))
        first = heaps.withColumn("r", F.row_number().over(order("item", "group"))).filter(F.col("r") <= k)
        last = first.withColumn("rank", F.row_number().over(order("item"))).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(mine)], "item long, item_id long")
        got = got.unionByName(last.join(F.broadcast(ids), "item").select("item_id", "rank", id_out().alias("doc_id"), "score"))
    return got
