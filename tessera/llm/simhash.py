"""SimHash near-dedup with covering locality-sensitive hashing.

For radius r, each bit position i gets a vector v(i) of r + 1 bits, and table t
(each nonzero vector) keeps the bits with an odd product v(i) . t. The at most r
differing bits of a near pair span at most r dimensions, so some t is orthogonal
to all of them, and in that table the two fingerprints agree: no pair within the
radius is missed (Pagh, 2016). Buckets are then checked exactly.

Only distinct fingerprints enter the tables, and a bucket emits a spanning
forest of its links, never all pairs. A bucket of more than BUCKET fingerprints
is linked by joins instead: its members differ in the bits the table leaves out
only, and two of them are within r bits exactly if flips of r/2 and r - r/2 free
bits lead both to a common value, so members that reach a value are tied to the
least of them. That takes some hundred rows for each member, whatever the size.

Defined results: null, empty or blank texts have fingerprint 0 and are linked
like any other. A null doc_id is below all ids. Repeated rows give a row each.
Texts of any length count whole; a bit set in exactly half the hashes is 0. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, id_out, id_text, rows, schema_of, stored
from .components import components

BITS = 64
#: Fingerprints in a bucket that one task compares; more are linked by joins.
BUCKET = 4096


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bit i is set if more than half of the shingles' XXH64 (seed 42) have it."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    flat, h = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return h(flat, 42)
    ends = list(accumulate(map(len, words), lambda a, x: a + x + 1))
    hashes = [h(flat[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp as a signed long."""
    out = schema_of("doc_id long,fp long")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in encoded(b.column(1))], np.uint64).view(np.int64)
            yield rows(out, b.column(0), fp)

    return id_text(docs).mapInArrow(per_batch, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """One mask of kept bits for each table, as signed longs."""
    top = (1 << radius + 1) - 1
    masks = (sum(1 << i for i in range(BITS) if (i % top + 1 & t).bit_count() % 2) for t in range(1, top + 1))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph of pairs within ``radius``."""
    left, a, b = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            found = left[near]
            left = left[~near]
            a.extend([x] * len(found))
            b.extend(found)
            queue.extend(found)
    return a, b


def bucket_links(radius: int, bucket: int):
    """Rows (t, k, fp), sorted, to rows (t, a, b): links of two fingerprints with
    t null, or the members (t, fp, fp) of a bucket too large for one task."""
    out = schema_of("t int,a long,b long")

    def batch_of(t, a, b) -> pa.RecordBatch:
        return rows(out, t, np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t0 = k0 = None
        large, kept = False, np.zeros(0, np.uint64)
        for batch in batches:
            t, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy().view(np.uint64)
            if not len(t):
                continue
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(t)]
            a, b, at = [], [], []
            # The first group may go on from the batch before.
            if t0 == t[0] and k0 == k[0]:
                first = np.concatenate([kept, fp[: ends[0]]])
            else:
                if not large and len(kept) > 1:
                    x, y = forest(kept, radius)
                    a.extend(x), b.extend(y), at.extend([None] * len(x))
                first, large = fp[: ends[0]], False
            if len(starts) > 1:  # the first group ends in this batch
                if large or len(first) > bucket:
                    at.extend([int(t[0])] * len(first)), a.extend(first), b.extend(first)
                elif len(first) > 1:
                    x, y = forest(first, radius)
                    a.extend(x), b.extend(y), at.extend([None] * len(x))
                large = False
                sizes = ends - starts
                two = np.flatnonzero(sizes[1:-1] == 2) + 1
                x, y = fp[starts[two]], fp[starts[two] + 1]
                near = np.bitwise_count(x ^ y) <= radius
                a.extend(x[near]), b.extend(y[near]), at.extend([None] * int(near.sum()))
                for j in np.flatnonzero(sizes[1:-1] > 2) + 1:
                    if sizes[j] > bucket:
                        m = fp[starts[j] : ends[j]]
                        at.extend([int(t[starts[j]])] * len(m)), a.extend(m), b.extend(m)
                    else:
                        x, y = forest(fp[starts[j] : ends[j]], radius)
                        a.extend(x), b.extend(y), at.extend([None] * len(x))
                first = fp[starts[-1] :]
            t0, k0, kept = t[-1], k[-1], first
            if large or len(kept) > bucket:
                at.extend([int(t0)] * len(kept)), a.extend(kept), b.extend(kept)
                large, kept = True, np.zeros(0, np.uint64)
            if a:
                yield batch_of(at, a, b)
        if not large and len(kept) > 1:
            a, b = forest(kept, radius)
            if a:
                yield batch_of([None] * len(a), a, b)

    return link


def links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """fps (fp), distinct, to links (a, b) whose components are those of all
    pairs within ``radius`` bits; each link is such a pair or, in a large
    bucket, a member and the least one with the same value within reach."""
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])).alias("x")).select("x.t", "x.k", "fp")
    found = stored(keyed.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(bucket_links(radius, bucket), "t int, a long, b long"), "links")
    # 2 flips for r = 4: a common value within r/2 and r - r/2 flips. Odd radii take the larger half on both sides and check.
    near = found.filter("t is null").select("a", "b")
    big = found.filter("t is not null").select("t", F.col("a").alias("fp"))
    if big.isEmpty():
        return near
    half = radius // 2
    if radius % 2:
        raise ValueError(f"buckets over {bucket} need an even radius")
    flips = []
    for m in masks:
        free = [i for i in range(BITS) if not m >> i & 1]
        own = [sum(1 << i for i in c) for n in range(half + 1) for c in combinations(free, n)]
        flips.append([x - (1 << 64) if x >> 63 else x for x in own])
    by_table = F.when(F.col("t") == 0, F.lit(flips[0]))
    for t in range(1, len(flips)):
        by_table = by_table.when(F.col("t") == t, F.lit(flips[t]))
    reach = big.select("t", "fp", F.explode(by_table).alias("x")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
    least = reach.groupBy("t", "z").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("top <> b").drop("top")
    stars = reach.join(least, ["t", "z"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return near.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``:
    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, fingerprint 16 hex digits."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comps = components(links(nodes.select("fp"), radius, bucket))
    tied = nodes.join(comps.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = tied.groupBy("component").agg(F.min("first").alias("component_id"))
    named = tied.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(id_out().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_out("component_id").alias("component_id"))
