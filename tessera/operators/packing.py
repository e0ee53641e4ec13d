"""Packing documents into fixed-length training rows.

Every packer takes a length table ``(doc_id, len, grp, ord)`` — lengths only,
tokens are joined back afterwards — and returns a layout
``(grp, row_id, pos, doc_id, start, len)``: row ``row_id`` of stream ``grp``
holds, from token ``pos`` on, the tokens ``[start, start+len)`` of ``doc_id``.

``pack_concat`` is closed-form (prefix sums). The greedy, first-fit and
best-fit packers are sequential folds by definition; the stream key ``grp``
is their unit of parallelism (as ranks are in a multi-GPU loader), each
stream is read in order by one task with bounded memory via ``mapInPandas``.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import prefix_sum

LAYOUT_SCHEMA = "grp long, row_id long, pos long, doc_id long, start long, len long"
LAYOUT_COLS = ["grp", "row_id", "pos", "doc_id", "start", "len"]


def pack_concat(lens: DataFrame, T: int) -> DataFrame:
    """Flat token stream per group cut every T+1 tokens; only full rows."""
    C = T + 1
    p = prefix_sum(lens.select("doc_id", "len", "grp", "ord"), "ord", "len", by=["grp"],
                   idx="_i", before="bef").drop("_i")
    tot = lens.groupBy("grp").agg((F.sum("len") / F.lit(C)).cast("bigint").alias("n_rows"))
    first = (F.col("bef") / F.lit(C)).cast("bigint")
    last = ((F.col("bef") + F.col("len") - 1) / F.lit(C)).cast("bigint")
    tot = tot.withColumnRenamed("grp", "_g")
    e = p.join(tot, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g").withColumn("row_id", F.explode(F.sequence(first, last)))
    e = e.filter(F.col("row_id") < F.col("n_rows"))
    lo = F.greatest(F.col("row_id") * C, F.col("bef"))
    hi = F.least((F.col("row_id") + 1) * C, F.col("bef") + F.col("len"))
    return e.select(
        F.col("grp").cast("bigint").alias("grp"),
        F.col("row_id").cast("bigint").alias("row_id"),
        (lo - F.col("row_id") * C).cast("bigint").alias("pos"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (lo - F.col("bef")).cast("bigint").alias("start"),
        (hi - lo).cast("bigint").alias("len"),
    )


# ---------------------------------------------------------------- folds

def _stream_fold(lens: DataFrame, fold, sort_cols=("grp", "ord")) -> DataFrame:
    """Run ``fold(grp, iterator of (doc_id, len) arrays)`` per stream.

    Rows are hash-partitioned by ``grp`` and sorted inside each partition, so
    a partition holds whole streams, in order; a stream may span many Arrow
    batches and a batch may hold several streams.
    """
    src = (lens.select(F.col("grp").cast("bigint").alias("grp"), F.col("ord"),
                       F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("len").cast("bigint").alias("len"))
               .repartition("grp").sortWithinPartitions(*sort_cols))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"grp": None, "packer": None}

        def flush_rows(rows):
            if rows:
                return pd.DataFrame(rows, columns=LAYOUT_COLS)
            return None

        for pdf in batches:
            out = []
            g = pdf["grp"].to_numpy()
            d = pdf["doc_id"].to_numpy()
            ln = pdf["len"].to_numpy()
            for i in range(len(pdf)):
                gi = int(g[i])
                if gi != state["grp"]:
                    if state["packer"] is not None:
                        out.extend(state["packer"].finish())
                    state["grp"], state["packer"] = gi, fold(gi)
                out.extend(state["packer"].push(int(d[i]), int(ln[i])))
            r = flush_rows(out)
            if r is not None:
                yield r
        if state["packer"] is not None:
            r = flush_rows(state["packer"].finish())
            if r is not None:
                yield r

    return src.mapInPandas(run, LAYOUT_SCHEMA)


class _GreedyCrop:
    """Docs in order; a doc that does not fit is cropped to fill the row and
    its rest is dropped. The last, unfinished row is not emitted."""

    def __init__(self, grp, C):
        self.g, self.C, self.row, self.pos, self.cur = grp, C, 0, 0, []

    def push(self, doc, n):
        take = min(n, self.C - self.pos)
        self.cur.append((self.g, self.row, self.pos, doc, 0, take))
        self.pos += take
        if self.pos == self.C:
            out, self.cur = self.cur, []
            self.row, self.pos = self.row + 1, 0
            return out
        return []

    def finish(self):
        return []


class _GreedyPad:
    """Docs in order; a doc that does not fit goes to the next row and the
    rest of the current row is padding. A doc longer than a row is cropped to
    one row. The last row is emitted padded."""

    def __init__(self, grp, C):
        self.g, self.C, self.row, self.pos, self.cur = grp, C, 0, 0, []

    def push(self, doc, n):
        out = []
        if self.pos > 0 and n > self.C - self.pos:
            out, self.cur = self.cur, []
            self.row, self.pos = self.row + 1, 0
        take = min(n, self.C)
        self.cur.append((self.g, self.row, self.pos, doc, 0, take))
        self.pos += take
        if self.pos == self.C:
            out = out + self.cur
            self.cur = []
            self.row, self.pos = self.row + 1, 0
        return out

    def finish(self):
        out, self.cur = self.cur, []
        return out


def pack_greedy_crop(lens: DataFrame, T: int) -> DataFrame:
    return _stream_fold(lens, lambda g: _GreedyCrop(g, T + 1))


def pack_greedy_pad(lens: DataFrame, T: int) -> DataFrame:
    return _stream_fold(lens, lambda g: _GreedyPad(g, T + 1))


class _FFD:
    """First-fit decreasing over a stream, docs cropped to one row.

    Input arrives sorted by length descending (then ord). Rows with room wait
    in a heap for each free space, and a tree over the free spaces holds the
    lowest row of each heap, so the first row with room for ``n`` is a minimum
    over the spaces from ``n`` on, O(log C). A row that is full is emitted and
    forgotten: what is held are the rows with room left, and O(C) for the tree.
    """

    def __init__(self, grp, C):
        self.g, self.C = grp, C
        self.size = 1 << C.bit_length()
        self.low = [math.inf] * (2 * self.size)
        self.waiting: dict[int, list[int]] = {}
        self.open: dict[int, list] = {}      # row: its placements so far
        self.n_rows = 0

    def _refresh(self, space):
        i = space + self.size
        self.low[i] = self.waiting[space][0] if self.waiting.get(space) else math.inf
        while i > 1:
            i //= 2
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])

    def _first_fit(self, n):
        """The free space whose heap has the lowest row with room for n, or -1."""
        lo, hi, best = n + self.size, 2 * self.size, 0
        while lo < hi:
            if lo & 1:
                best, lo = (lo if self.low[lo] < self.low[best] else best), lo + 1
            if hi & 1:
                hi -= 1
                best = hi if self.low[hi] < self.low[best] else best
            lo, hi = lo // 2, hi // 2
        if self.low[best] == math.inf:
            return -1
        while best < self.size:
            best = 2 * best if self.low[2 * best] <= self.low[2 * best + 1] else 2 * best + 1
        return best - self.size

    def push(self, doc, n):
        n = min(n, self.C)
        space = self._first_fit(n)
        if space < 0:
            space, r = self.C, self.n_rows
            self.n_rows += 1
            self.open[r] = []
        else:
            r = heapq.heappop(self.waiting[space])
            self._refresh(space)
        self.open[r].append((self.g, r, self.C - space, doc, 0, n))
        if space == n:                       # a full row never changes again: emit it
            return self.open.pop(r)
        heapq.heappush(self.waiting.setdefault(space - n, []), r)
        self._refresh(space - n)
        return []

    def finish(self):
        return [p for r in sorted(self.open) for p in self.open[r]]


def pack_ffd(lens: DataFrame, T: int) -> DataFrame:
    """First-fit decreasing per stream, padding the rest of each row.

    FFD needs the whole stream sorted by length, so the stream is sorted by
    Spark (external sort, spills) and placed in one pass; memory is the open
    rows' free space, not the documents.
    """
    l2 = lens.withColumn("_neg", -F.col("len"))
    return _stream_fold(l2, lambda g: _FFD(g, T + 1), sort_cols=("grp", "_neg", "ord"))


class _BestFitCrop:
    """Best-fit with cropping over a bounded buffer of ``buffer`` documents.

    Before every pick the buffer is refilled to ``buffer`` docs (while input
    remains). Pick the largest doc that fits (first arrived on ties); if none
    fits, crop the shortest doc (first arrived on ties) to fill the row
    exactly; its rest is dropped. Every row is full. When input ends the
    buffer is drained; a last partial row is dropped.

    The buffer is kept as a sorted list of (len, arrival) so both picks are
    O(log buffer) searches instead of linear scans.
    """

    def __init__(self, grp, C, buffer, refill):
        self.g, self.C, self.B, self.refill = grp, C, buffer, max(1, refill)
        self.buf = []         # sorted (len, arrival, doc)
        self.stage = []       # docs of the batch being read
        self.arr = 0
        self.row, self.pos, self.cur = 0, 0, []

    def _pick(self):
        remaining = self.C - self.pos
        buf = self.buf
        # largest len <= remaining; among equal len, the earliest arrival
        i = bisect.bisect_right(buf, (remaining, float("inf"), 0))
        if i > 0:
            best_len = buf[i - 1][0]
            j = bisect.bisect_left(buf, (best_len, -1, 0))
            ln, _, doc = buf.pop(j)
            self.cur.append((self.g, self.row, self.pos, doc, 0, ln))
            self.pos += ln
        else:
            ln, _, doc = buf.pop(0)  # shortest, earliest
            self.cur.append((self.g, self.row, self.pos, doc, 0, remaining))
            self.pos += remaining
        if self.pos == self.C:
            out, self.cur = self.cur, []
            self.row, self.pos = self.row + 1, 0
            return out
        return []

    def _take_stage(self):
        for item in self.stage:
            bisect.insort(self.buf, item)
        self.stage = []

    def push(self, doc, n):
        self.stage.append((n, self.arr, doc))
        self.arr += 1
        out = []
        if len(self.stage) >= self.refill:
            self._take_stage()
            while len(self.buf) >= self.B:
                out.extend(self._pick())
        return out

    def finish(self):
        self._take_stage()
        out = []
        while self.buf:
            out.extend(self._pick())
        return out


def pack_bestfit_crop(lens: DataFrame, T: int, buffer: int = 1000, refill: int = 128) -> DataFrame:
    """Best-fit crop per stream; docs enter the buffer in batches of ``refill``."""
    return _stream_fold(lens, lambda g: _BestFitCrop(g, T + 1, buffer, refill))


# ---------------------------------------------------------------- report

def packing_report(layout: DataFrame, lens: DataFrame, T: int, algo: str) -> DataFrame:
    """Utilisation, crop and pad shares of one layout, and the lower bound on
    crop (share of tokens in docs longer than a row)."""
    C = T + 1
    a = lens.select(F.lit(0).alias("_t"), F.col("len").cast("bigint").alias("_l"),
                    F.lit(None).cast("bigint").alias("_g"), F.lit(None).cast("bigint").alias("_r"))
    b = layout.select(F.lit(1).alias("_t"), F.col("len").cast("bigint").alias("_l"),
                      F.col("grp").cast("bigint").alias("_g"), F.col("row_id").cast("bigint").alias("_r"))
    u = a.unionByName(b)
    is_in, is_out = F.col("_t") == 0, F.col("_t") == 1
    r = u.agg(F.sum(F.when(is_in, F.col("_l"))).cast("bigint").alias("input_tokens"),
              F.sum(F.when(is_in, F.greatest(F.col("_l") - F.lit(C), F.lit(0)))).cast("bigint").alias("beyond"),
              F.coalesce(F.sum(F.when(is_out, F.col("_l"))), F.lit(0)).cast("bigint").alias("placed_tokens"),
              F.count_distinct(F.when(is_out, F.struct("_g", "_r"))).cast("bigint").alias("n_rows"))
    cap = F.col("n_rows") * F.lit(C)
    return r.select(
        F.lit(algo).alias("algo"),
        F.col("n_rows"),
        F.col("input_tokens"),
        F.col("placed_tokens"),
        (cap - F.col("placed_tokens")).cast("bigint").alias("pad_tokens"),
        (F.col("input_tokens") - F.col("placed_tokens")).cast("bigint").alias("dropped_tokens"),
        F.round(F.col("placed_tokens") * 100.0 / cap, 4).alias("util_pct"),
        F.round((F.col("input_tokens") - F.col("placed_tokens")) * 100.0 / F.col("input_tokens"), 4).alias("crop_pct"),
        F.round((cap - F.col("placed_tokens")) * 100.0 / cap, 4).alias("pad_pct"),
        F.round(F.col("beyond") * 100.0 / F.col("input_tokens"), 4).alias("lower_bound_pct"),
    )


def shift_targets(rows: DataFrame, ids: str = "ids", mask: str | None = "mask",
                  ignore: int = -1) -> DataFrame:
    """inputs = ids[:-1], targets = ids[1:]; targets become ``ignore`` where the
    shifted mask is 0."""
    n = F.size(F.col(ids))
    inputs = F.slice(F.col(ids), 1, n - 1)
    targets = F.slice(F.col(ids), 2, n - 1)
    if mask is not None:
        m = F.slice(F.col(mask), 2, n - 1)
        targets = F.zip_with(targets, m, lambda t, k: F.when(k == 0, F.lit(ignore)).otherwise(t))
    return rows.withColumn("inputs", inputs).withColumn("targets", targets)


def pad_batches(seqs: DataFrame, batch: str, pad: int, ids: str = "ids") -> DataFrame:
    """Right-pad every sequence to the longest of its batch with ``pad``.

    The batch maximum is a grouped aggregate joined back (batches are small
    groups of the same key), so no row is moved to a single task.
    """
    mx = seqs.groupBy(batch).agg(F.max(F.size(ids)).alias("padded_len"))
    return (seqs.join(mx, batch)
                .withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.col("padded_len") - F.size(ids)))))
