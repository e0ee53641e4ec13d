"""Packing token ids into fixed-length sequences: cutting stock by column
generation on the length histogram.

A document of more than a sequence is cut into full sequences and a rest.
Rests are put into classes of UNIT tokens, and the histogram of the classes
(``length / UNIT`` rows, whatever the corpus) goes to the driver, where a linear
program over patterns is solved: a knapsack by dynamic programming prices new
columns until none helps. Rounded patterns are given out to the rests by their
rank within the class, in Spark. What a pattern leaves empty is filled: one
document of RESERVE, by the hash of its id, is kept out of the patterns, and
the ids of these are laid end to end and cut to fit the gaps; what remains of
them makes full sequences and a tail of lengths that are powers of two, which
need no padding. If the reserve is used up, the gaps left are padding.

Every id lies in exactly one piece. Defined results: a null or empty text is
the end token alone. Repeated rows and null ids are packed like any other row,
a piece for each. A text of any length is cut into sequences; pieces of equal rank
keys are alike, so ties don't matter. Other columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoded, id_out, id_text, rows, schema_of, stored
from .cutting import patterns
from .ranks import running
from .wordids import encoder

#: Width of a length class, in tokens.
UNIT = 16
#: One document of so many fills gaps.
RESERVE = 16
#: Tokens of the filling line that are cut at a time: some hundred gaps.
LINE = 1 << 14
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, reserve: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, kind, ids): full sequences
    and rests, and whole documents of the reserve with their ids."""
    out = schema_of("doc_id long,start long,length long,ids_crc32 long,doc_tokens long,kind string,ids binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            got = []
            for i, ids in zip(b.column(0).to_pylist(), enc.ids(encoded(b.column(1)))):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                n = len(ids)
                if reserve and zlib.crc32(b"%d" % i) % reserve == 0:
                    got.append((i, 0, n, 0, n, "fill", ids.tobytes()))
                else:
                    got += [(i, s, len(p), _crc(p), n, "full" if len(p) == length else "rest", None) for s in range(0, n, length) for p in (ids[s : s + length],)]
            yield rows(out, *(list(zip(*got)) or [[]] * 7))

    return id_text(docs).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind string, ids binary")


def _slots(packed: list[tuple[int, dict[int, int]]], first: int) -> tuple[dict[int, np.ndarray], int]:
    """class to rows (first rank, sequences, first sequence), by first rank: ranks
    from a row on go to the sequences of its pattern, one copy after the other."""
    by, at, rank = defaultdict(list), first, defaultdict(int)
    for times, copies in packed:
        for c, n in copies.items():
            by[c].append((rank[c], times, at))
            rank[c] += times * n
        at += times
    return {c: np.array(x, np.int64) for c, x in by.items()}, at


def _assign(slots: dict[int, np.ndarray]):
    out = schema_of("doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,slot long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                own = np.flatnonzero(cls == c)
                table = slots[int(c)]
                row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                copy, k = np.divmod(rank[own] - row[:, 0], row[:, 1])
                seq[own] = row[:, 2] + k
                slot[own] = (int(c) << 32) + copy
            yield rows(out, *b.columns[:5], seq, slot)

    return assign


def _fill(gaps_end: int, line_end: int, next_sequence: int, length: int):
    """Cut a stretch of the filling line at the bounds of its gaps."""
    spare = line_end - gaps_end
    full, tail = divmod(max(0, spare), length)
    powers = [1 << i for i in reversed(range(tail.bit_length())) if tail >> i & 1]
    bounds = np.concatenate([gaps_end + length * np.arange(full + 1, dtype=np.int64), gaps_end + length * full + np.cumsum(powers, dtype=np.int64)]) if spare > 0 else np.zeros(0, np.int64)

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows:
            at = np.argsort(g0 := right["pos"].to_numpy(), kind="stable")
            g0, g1, seq, off = (right[c].to_numpy()[at] for c in ("pos", "end", "sequence_id", "offset"))
            for i, n, p, start, ids in sorted(zip(*(left[c].to_pylist() for c in ("doc_id", "doc_tokens", "pos", "start", "ids"))), key=lambda x: x[2]):
                ids = np.frombuffer(ids, "<u4")
                a, end = p, p + len(ids)
                while a < end:
                    if a < gaps_end:
                        j = int(np.searchsorted(g0, a, "right")) - 1
                        b, s, o = min(end, int(g1[j])), int(seq[j]), int(off[j] + a - g0[j])
                    elif (j := int(np.searchsorted(bounds, a, "right")) - 1) < len(bounds) - 1:
                        b, s, o = min(end, int(bounds[j + 1])), next_sequence + j, int(a - bounds[j])
                    piece = ids[a - p : b - p]
                    got.append((i, start + a - p, len(piece), _crc(piece), n, s, o))
                    a = b
        kind = schema_of(PIECE.replace(", ", ","))
        return pa.Table.from_batches([rows(kind, *(list(zip(*got)) or [[]] * 7))], kind)

    return fill


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, unit: int = UNIT, reserve: int = RESERVE) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)
    of sequences of at most ``length`` tokens (a power of two). ``tokenizer``:
    path of a tokenizers file for which ``wordids`` holds, the same on all
    executors. ``reserve`` 0 fills no gap."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, end_id, length, reserve), "pieces")
    rest = pieces.filter("kind = 'rest'").withColumn("cls", F.ceil(F.col("length") / unit).cast("long"))
    histogram = {r["cls"]: r["count"] for r in rest.groupBy("cls").count().collect()}
    full = running(pieces.filter("kind = 'full'").drop("ids", "kind"), F.lit(1), ["doc_id", "start", "ids_crc32"], "sequence_id")
    n_full = pieces.filter("kind = 'full'").count()
    slots, next_sequence = _slots(patterns(histogram, length // unit), n_full)
    ranked = running(rest, F.lit(1), ["doc_id", "start", "ids_crc32"], "rank", ["cls"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank")
    placed = ranked.mapInArrow(_assign(slots), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    order = W.partitionBy("sequence_id").orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, -1)
    placed = stored(placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))), "placed")
    fills = pieces.filter("kind = 'fill'").select("doc_id", "doc_tokens", "ids_crc32", "ids")
    line = running(fills, F.col("doc_tokens"), ["doc_id", "doc_tokens", "ids"], "pos")
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("offset"))
    # A sequence whose length is a power of two needs no padding.
    gaps = used.filter((F.col("offset") < length) & (F.col("offset").bitwiseAND(F.col("offset") - 1) != 0)).withColumn("gap", length - F.col("offset"))
    gaps = running(gaps, F.col("gap"), ["sequence_id"], "pos").withColumn("end", F.col("pos") + F.col("gap"))
    gaps_end = gaps.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
    line_end = fills.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    chunk = F.explode(F.sequence(F.floor(F.col("pos") / LINE), F.floor((F.col("end") - 1) / LINE)))
    gaps = gaps.select("pos", "end", "sequence_id", "offset", chunk.alias("chunk"))
    line = line.withColumn("end", F.col("pos") + F.col("doc_tokens")).withColumn("chunk", chunk)
    lo = F.greatest(F.col("pos"), F.col("chunk") * LINE)
    hi = F.least(F.col("end"), (F.col("chunk") + 1) * LINE)
    line = line.select("doc_id", "doc_tokens", "chunk", lo.alias("pos"), (lo - F.col("pos")).alias("start"), F.expr("substring(ids, cast(4 * (greatest(pos, chunk * {0}) - pos) + 1 as int), cast(4 * (least(end, (chunk + 1) * {0}) - greatest(pos, chunk * {0})) as int))".format(LINE)).alias("ids"))
    filled = line.groupBy("chunk").cogroup(gaps.groupBy("chunk")).applyInArrow(_fill(gaps_end, line_end, next_sequence, length), PIECE)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = full.withColumn("offset", F.lit(0).cast("long")).select(cols).unionByName(placed.select(cols)).unionByName(filled.select(cols))
    return whole.withColumn("doc_id", id_out())
