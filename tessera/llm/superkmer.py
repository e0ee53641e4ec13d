"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of its
runs of M words; consecutive windows with the same minimiser overlap, and travel
as one packed string of words to the bucket of that minimiser, so equal windows
always meet. A map task sends its strings of a bucket in one compressed block;
a string that it has already sent for a smaller document is settled on the spot
(its windows start in that document too), so a passage held by a third of all
documents reaches its bucket once for each map task, not once for each document.
A bucket sorts its windows; equal neighbours are compared word by word.

Defined results: null, empty and blank texts have no words. A null doc_id is
below all ids. Rows that repeat a doc_id are one document: none of them makes a
window of another a repeat, and each row loses its own words. Texts of any
length count whole; ties in the order of windows don't matter. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, id_out, id_text, rows, schema_of

#: Words in a run whose hash may be the minimiser.
M = 3
#: Bytes of text that a map task works on at once, and of strings that it holds back.
WORK, HELD = 4 << 20, 32 << 20
#: Strings a map task remembers to settle repeats itself; no result depends on it.
REMEMBERED = 200_000
#: Bytes of packed strings in a bucket, about.
BUCKET_BYTES = 8 << 20
_ODD = [pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbours."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out += h[j : j + len(out)] * np.uint64(_ODD[j])
    return _mixed(out)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    step = 1
    while 2 * step <= n:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def text_mark(text: bytes) -> int:
    """Tells rows with the same doc_id and different texts apart."""
    return xxhash.xxh32_intdigest(text, 1)


def _runs(doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows (doc, mark, at) as stretches (doc, mark, first, how many)."""
    order = np.lexsort((at, mark, doc))
    doc, mark, at = doc[order], mark[order], at[order]
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(mark) != 0) | (np.diff(at) != 1)][: len(doc)]
    first = np.flatnonzero(new)
    return doc[first], mark[first], at[first], np.diff(np.r_[first, len(doc)])


OUT = "bucket long,block binary,doc_id long,mark long,first long,n long"


def super_kmers(window: int, buckets: int, marked: bool = True):
    """Rows (doc_id, text) to blocks (bucket, block) and settled stretches
    (doc_id, mark, first, n). Without ``marked`` every mark is 0."""
    out = schema_of(OUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent, zip_ = _Hashes(), {}, zstandard.ZstdCompressor(6)
        held: list[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def settled(doc, mark, at, n) -> pa.RecordBatch:
            k = len(doc)
            return rows(out, doc % buckets, [None] * k, doc, mark, at, n)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                bucket, doc, mark, at = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3, 4))
                strings = [s for x in held for s in x[1]]
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                names, blocks = [], []
                for own in np.split(order, cuts):
                    body = b"\n".join([strings[i] for i in own])
                    names.append(int(bucket[own[0]]))
                    blocks.append(zip_.compress(len(own).to_bytes(4, "little") + np.diff(doc[own].astype("<i8"), prepend=0).tobytes() + mark[own].astype("<u4").tobytes() + at[own].astype("<u4").tobytes() + body))
                for i in range(0, len(names), 256):
                    n = len(names[i : i + 256])
                    yield rows(out, names[i : i + 256], blocks[i : i + 256], *[[None] * n] * 4)
            held, size = [], 0

        def work(ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            if len(hashes) > 1_000_000:
                hashes.clear()
            split = [t.split() for t in texts]
            counts = np.array([len(w) for w in split])
            words = [x for w in split for x in w]
            n = len(words) - window + 1
            if n <= 0:
                return
            ends = np.cumsum([len(x) + 1 for x in words]) - 1
            flat = b" ".join(words)
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            owner = np.repeat(np.arange(len(texts)), counts)
            start = np.repeat(np.cumsum(counts) - counts, counts)
            low = _sliding_min(_run_hash(h, M), window - M + 1)
            whole = owner[:n] == owner[window - 1 :]
            new = np.r_[True, (np.diff(low) != 0) | (np.diff(owner[:n]) != 0) | (np.diff(whole) != 0)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], n] - 1
            keep = whole[first]
            first, last = first[keep], last[keep]
            if not len(first):
                return
            a = np.where(first > 0, ends[first - 1] + 1, 0).tolist()
            b = ends[last + window - 1].tolist()
            strings = [flat[x:y] for x, y in zip(a, b)]
            doc = np.array(ids, np.int64)[owner[first]]
            mark = np.array([text_mark(t) if marked else 0 for t in texts], np.int64)[owner[first]]
            at = first - start[first]
            ship = np.ones(len(first), bool)
            for k, (s, d) in enumerate(zip(strings, doc.tolist())):
                was = sent.get(s)
                if was is None or d < was:
                    if was is not None or len(sent) < REMEMBERED:
                        sent[s] = d
                elif was < d:
                    ship[k] = False
            done = np.flatnonzero(~ship)
            if len(done):
                n_win = (last - first + 1)[done]
                all_at = np.repeat(at[done], n_win) + np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
                yield settled(*_runs(np.repeat(doc[done], n_win), np.repeat(mark[done], n_win), all_at))
            go = np.flatnonzero(ship)
            held.append(((low[first[go]] % np.uint64(buckets)).astype(np.int64), [strings[i] for i in go], doc[go], mark[go], at[go]))
            size += sum(map(len, held[-1][1]))
            if size > HELD:
                yield from flush()

        ids, texts, got = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                ids.append(i), texts.append(t)
                got += len(t)
                if got > WORK:
                    yield from work(ids, texts)
                    ids, texts, got = [], [], 0
        yield from work(ids, texts)
        yield from flush()

    return cut


def repeated_windows(blocks: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Stretches (doc, mark, first, n) of the windows in a bucket's blocks that
    also start in a document with a smaller id."""
    doc, mark, at, body = [], [], [], []
    for z in blocks:
        x = zstandard.ZstdDecompressor().decompress(z)
        n = int.from_bytes(x[:4], "little")
        doc.append(np.cumsum(np.frombuffer(x, "<i8", n, 4))), mark.append(np.frombuffer(x, "<u4", n, 4 + 8 * n)), at.append(np.frombuffer(x, "<u4", n, 4 + 12 * n))
        body.append(x[4 + 16 * n :])
    doc, mark, at = np.concatenate(doc), np.concatenate(mark).astype(np.int64), np.concatenate(at).astype(np.int64)
    none = (doc[:0], mark[:0], at[:0], at[:0])
    if doc.min() == doc.max():
        return none
    text = b"\n".join(body)
    byte = np.frombuffer(text, np.uint8)
    ends = np.cumsum((byte == 32) | (byte == 10))[np.flatnonzero(byte == 10)]
    words = text.split()
    counts = np.diff(np.r_[0, ends, len(words)])
    codes = np.fromiter(map(_Codes().__getitem__, words), np.int64, len(words))
    del words
    owner = np.repeat(np.arange(len(doc)), counts)
    start = np.repeat(np.cumsum(counts) - counts, counts)
    n = len(codes) - window + 1
    w = np.flatnonzero(owner[:n] == owner[window - 1 :])
    h = _run_hash(_mixed(codes.astype(np.uint64) + np.uint64(1)), window)[w]
    order = np.argsort(h, kind="stable")
    same = np.diff(h[order]) == 0
    x, y = w[order[1:][same]], w[order[:-1][same]]
    if not all((codes[x + j] == codes[y + j]).all() for j in range(window)):  # two windows share a hash
        matrix = np.lib.stride_tricks.sliding_window_view(codes, window)[w]
        order = np.lexsort(matrix.T)
        same = (matrix[order[1:]] == matrix[order[:-1]]).all(1)
    first = np.flatnonzero(np.r_[True, ~same])
    d = doc[owner[w[order]]]
    least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(d)]))
    hit = w[order[d > least]]
    return _runs(doc[owner[hit]], mark[owner[hit]], at[owner[hit]] + hit - start[hit]) if len(hit) else none


def settle(window: int):
    """Blocks, sorted by bucket, to stretches (doc_id, mark, first, n)."""
    out = schema_of("doc_id long,mark long,first long,n long")

    def per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for b in batches:
            ready = b.filter(b.column(1).is_null())
            if ready.num_rows:
                yield rows(out, *ready.columns[2:])
            for bucket, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block is None:
                    continue
                if bucket != now and blocks:
                    yield rows(out, *repeated_windows(blocks, window))
                    blocks = []
                now = bucket
                blocks.append(block)
        if blocks:
            yield rows(out, *repeated_windows(blocks, window))

    return per_bucket


def without_words(window: int):
    """Rows (doc_id, text, first, n) to (doc_id, kept, n_words, n_removed)."""
    out = schema_of("doc_id long,kept string,n_words long,n_removed long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone = [], [], []
            for t, firsts, ns in zip(encoded(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = t.split()
                if firsts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, firsts, 1)
                    np.add.at(edge, np.array(firsts) + np.array(ns) + window - 1, -1)
                    left = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist()) if not c]
                else:
                    left = words
                kept.append(b" ".join(left).decode())
                total.append(len(words))
                gone.append(len(words) - len(left))
            yield rows(out, b.column(0), kept, total, gone)

    return cut


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, kept, n_words, n_removed) for each row of ``docs``: without the
    words covered by a window that also starts in a document with a smaller id."""
    if window <= M:
        raise ValueError(f"a window has more than {M} words")
    own = id_text(docs)
    size = own.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("rows")).first()
    buckets, marked = max(1024, int(size[0] * 3.5 / BUCKET_BYTES)), (size[1] or 0) > 1
    ddl = "bucket long, block binary, doc_id long, mark long, first long, n long"
    sent = own.mapInArrow(super_kmers(window, buckets, marked), ddl)
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle(window), "doc_id long, mark long, first long, n long")
    by_doc = found.groupBy("doc_id", "mark").agg(F.collect_list("first").alias("first"), F.collect_list("n").alias("n"))

    @F.pandas_udf("long")
    def mark(texts):
        return texts.map(lambda t: text_mark((t or "").encode()))

    got = own.withColumn("mark", mark("text") if marked else F.lit(0).cast("long")).join(by_doc, ["doc_id", "mark"], "left").select("doc_id", "text", "first", "n")
    return got.mapInArrow(without_words(window), "doc_id long, kept string, n_words long, n_removed long").withColumn("doc_id", id_out())
