"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

A ``LineIndex`` is a folder with two tables. ``refs`` is a log of line
references (key, doc_id, sign, batch): the reference-count table, from which
every count and every largest document follows exactly. ``filters`` has one
cuckoo filter for each shard of the key space, holding each live key once. A
batch asks its filter first: a key that the filter doesn't hold is new without
a look at the reference table; only the others are joined with it. Deleting
documents logs negative references and takes keys that nobody holds any more
out of the filters, after which the index is as if they had never come.

A whole table is indexed in BATCHES by a hash of doc_id. Keys that no filter knew
and that a batch holds once are never looked at again; what two documents hold is
listed as met again, and only references of such keys are counted and joined.

Defined results: a null or empty text is one empty line. Lines and texts of any
length count whole; ties don't arise. A null doc_id is one
document with an id below all others. Rows that repeat a doc_id are one
document for the counts, and each row loses its own lines. Other columns of
the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, encoded, id_in, id_out, id_text, rows, schema_of, scratch, stored
from .cuckoo import CuckooFilter

#: Keys in one shard, about: 8 MB of keys while its filter is updated.
SHARD_KEYS = 250_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a line (stripped, ASCII lower-cased); None if shorter than
    ``min_chars`` code points. Two different lines of 2**40 share a key with a
    chance of 2**-49, so keys stand for lines."""
    k = line.strip(SPACE).lower()
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(k)


def line_refs(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(key, doc_id): each key of each document, once a row of ``docs``."""
    out = schema_of("key binary,doc_id long")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, d = [], []
            for i, t in zip(b.column(0).to_pylist(), encoded(b.column(1))):
                own = {line_key(x, min_chars) for x in t.split(b"\n")} - {None}
                k.extend(own)
                d.extend([i] * len(own))
            yield rows(out, k, d)

    return id_text(docs).mapInArrow(keys, "key binary, doc_id long")


def without_lines(docs: DataFrame, drops: DataFrame, min_chars: int = 20) -> DataFrame:
    """docs (doc_id, text, ...) less the lines whose key is in ``drops``
    (doc_id, keys array<binary>); (doc_id, kept, n_lines, n_dropped)."""
    out = schema_of("doc_id long,kept string,n_lines long,n_dropped long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, m = [], [], []
            for t, ks in zip(encoded(b.column(1)), b.column(2).to_pylist()):
                lines = t.split(b"\n")
                if ks:
                    ks = set(ks)
                    left = [x for x in lines if line_key(x, min_chars) not in ks]
                else:
                    left = lines
                kept.append(b"\n".join(left).decode("utf-8", "replace"))
                n.append(len(lines))
                m.append(len(lines) - len(left))
            yield rows(out, b.column(0), kept, n, m)

    got = id_text(docs).join(drops.select("doc_id", "keys"), "doc_id", "left").select("doc_id", "text", "keys")
    return got.mapInArrow(cut, "doc_id long, kept string, n_lines long, n_dropped long").withColumn("doc_id", id_out())


class LineIndex:
    def __init__(self, spark: SparkSession, root: str, min_chars: int = 20, shards: int | None = None):
        """``root``: a folder that all executors share. ``shards``: shards of the
        key space; by default sized by the first batch. A key's shard is fixed."""
        self.spark, self.root, self.min_chars, self.shards, self.batch, self.generation = spark, root.rstrip("/"), min_chars, shards, 0, 0
        self.parts: list[str] = []
        self.met: list[str] = []
        self.deleted = False

    # --- the exact table ---
    def _log(self, refs: DataFrame, sign: int) -> DataFrame:
        self.batch += 1
        path = f"{self.root}/refs/{self.batch:06d}"
        refs.select("key", "doc_id", F.lit(sign).alias("sign"), F.lit(self.batch).alias("batch")).write.parquet(path)
        self.parts.append(path)
        return self.spark.read.parquet(path)

    def refs(self) -> DataFrame:
        """(key, doc_id): the live references, each once."""
        if not self.parts:
            return self.spark.createDataFrame([], "key binary, doc_id long")
        log = self.spark.read.parquet(*self.parts)
        if len(self.parts) == 1:
            return log.select("key", "doc_id").distinct()
        return log.groupBy("key", "doc_id").agg(F.max_by("sign", "batch").alias("s")).filter("s > 0").select("key", "doc_id")

    def live_keys(self) -> DataFrame:
        """(key): all keys that a document holds."""
        return (self.refs() if self.deleted else self.spark.read.parquet(*self.parts)).select("key").distinct()

    def counts(self) -> DataFrame:
        """(key, n_docs, max_doc): documents that hold a key, and the last of them."""
        return self.refs().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))

    # --- the filters ---
    def filters(self) -> DataFrame:
        """(shard, slots), a row for each shard that has had a key."""
        if not self.generation:
            return self.spark.createDataFrame([], "shard int, slots binary")
        return self.spark.read.parquet(f"{self.root}/filters/{self.generation:06d}")

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"), "key")

    def _update(self, keys: DataFrame, add: bool) -> None:
        """Insert (or delete) the hashes of ``keys`` (key), each once. A shard
        whose filter is full is built anew from the live keys."""
        def change(left: pa.Table, right: pa.Table) -> pa.Table:
            hashes = [int.from_bytes(k[:8], "little") for k in left["key"].to_pylist()]
            if not right.num_rows:
                slots = CuckooFilter.build(hashes, len(hashes)).dump()
            else:
                f = CuckooFilter(slots=right["slots"][0].as_py())
                fits = all(f.insert(h) for h in hashes) if add else [f.delete(h) for h in hashes] is not None
                slots = f.dump() if fits else None
            return pa.table({"shard": pa.array([(left if left.num_rows else right)["shard"][0].as_py()], pa.int32()), "slots": pa.array([slots], pa.binary())})

        def anew(left: pa.Table) -> pa.Table:
            hashes = [int.from_bytes(k[:8], "little") for k in left["key"].to_pylist()]
            return pa.table({"shard": left["shard"][:1].cast(pa.int32()), "slots": pa.array([CuckooFilter.build(hashes, 2 * len(hashes)).dump()], pa.binary())})

        got = self._sharded(keys).groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(change, "shard int, slots binary")
        self.generation += 1
        path = f"{self.root}/filters/{self.generation:06d}"
        if self.generation == 1 or not add:
            got.write.parquet(path)
            return
        changed = stored(got, "filters")
        full = changed.filter("slots is null").select("shard")
        live = self._sharded(self.refs().select("key").distinct()).join(full, "shard", "left_semi")
        changed.filter("slots is not null").unionByName(live.groupBy("shard").applyInArrow(anew, "shard int, slots binary")).write.parquet(path)

    def maybe_live(self, keys: DataFrame) -> DataFrame:
        """(key, maybe): false where the filter shows that no document holds it."""
        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            ks = left["key"].to_pylist()
            f = CuckooFilter(slots=right["slots"][0].as_py()) if right.num_rows else None
            return pa.table({"key": pa.array(ks, pa.binary()), "maybe": pa.array([f is not None and int.from_bytes(k[:8], "little") in f for k in ks], pa.bool_())})

        return self._sharded(keys).groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(probe, "key binary, maybe boolean")

    # --- what users call ---
    def insert(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text); ones that are there already change nothing."""
        self.insert_refs(line_refs(docs, self.min_chars))

    def insert_refs(self, refs: DataFrame) -> None:
        """Add (key, doc_id). The filters are asked for each of the batch's keys:
        one they don't know has no reference yet, and unless the batch itself has it
        twice it stays out of the table of keys met again and of every later join."""
        before = self.live_keys() if self.parts else None
        own = self._log(refs, 1).groupBy("key").agg(F.count_distinct("doc_id").alias("n"))
        own = stored(own, "batch-keys")
        if before is None:
            self._met(own.filter("n > 1").select("key"))
            if self.shards is None:
                self.shards = max(64, -(-own.count() // SHARD_KEYS))
            self._update(own.select("key"), True)
            return
        probed = stored(self.maybe_live(own.select("key")), "probed")
        known = probed.filter("maybe").select("key")
        self._met(own.filter("n > 1").select("key").unionByName(known).distinct())
        fresh = known.join(before, "key", "left_anti")
        self._update(probed.filter("not maybe").select("key").unionByName(fresh), True)

    def _met(self, keys: DataFrame) -> None:
        path = f"{self.root}/met/{self.batch:06d}"
        keys.write.parquet(path)
        self.met.append(path)

    def met_again(self) -> DataFrame:
        """(key): all keys that two documents have held, and the few that a filter
        took for such."""
        return self.spark.read.schema("key binary").parquet(*self.met).distinct() if self.met else self.spark.createDataFrame([], "key binary")

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents (doc_id) out again, whatever batch they came in."""
        if not self.parts:
            return
        self.deleted = True
        gone = self._log(self.refs().join(doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id")).distinct(), "doc_id", "left_semi"), -1)
        self._update(gone.select("key").distinct().join(self.refs().select("key").distinct(), "key", "left_anti"), False)

    def drops(self, min_docs: int = 3) -> DataFrame:
        """(doc_id, keys): of each document the keys held by at least
        ``min_docs`` documents (two at least) of which it is not the last. Only
        references of keys met again are counted and joined. Both joins are
        between written tables, so Spark splits a line that very many hold."""
        again = stored(self.met_again(), "again")
        # Dealt by key and document before it meets the join on the key alone.
        refs = stored(stored(self.refs(), "live").join(again.hint("merge"), "key", "left_semi"), "repeated-refs")
        often = refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")).filter(F.col("n_docs") >= max(2, min_docs))
        often = stored(often, "often")
        return refs.join(often.hint("merge"), "key").filter("doc_id <> max_doc").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


#: Batches in which a whole table is indexed, by the hash of doc_id.
BATCHES = 3


def indexed(docs: DataFrame, min_chars: int = 20, root: str | None = None, batches: int = BATCHES) -> LineIndex:
    """An index of ``docs``, inserted in ``batches``: each asks the filters of those before."""
    index = LineIndex(docs.sparkSession, root or scratch(docs.sparkSession, "lines"), min_chars)
    path = scratch(docs.sparkSession, "line-refs")
    of = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("of")
    line_refs(docs, min_chars).select("key", "doc_id", of).write.partitionBy("of").parquet(path)
    refs = docs.sparkSession.read.schema("key binary, doc_id long, of int").parquet(path)
    for k in range(batches):
        index.insert_refs(refs.filter(F.col("of") == k).select("key", "doc_id"))
    return index


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, root: str | None = None) -> DataFrame:
    """Index ``docs`` and drop each line that at least ``min_docs`` documents
    hold from all but the last of them: (doc_id, kept, n_lines, n_dropped)."""
    return without_lines(docs, indexed(docs, min_chars, root).drops(min_docs), min_chars)


def dedup_documents(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with its own columns, its texts without repeated lines and, if it
    has that column, n_chars to match. Documents that lose a line and have no
    text but white space left go; untouched ones stay as they are."""
    index = indexed(docs, min_chars)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, keys: pd.Series) -> pd.Series:
        def one(t, ks):
            if t is None or ks is None:
                return t
            ks = {bytes(k) for k in ks}
            return b"\n".join(x for x in t.encode().split(b"\n") if line_key(x, min_chars) not in ks).decode()
        return pd.Series([one(t, k) for t, k in zip(texts, keys)], dtype=object)

    drops = index.drops(min_docs).withColumnsRenamed({"doc_id": "__row_id", "keys": "__row_keys"})
    got = docs.withColumn("__row_id", id_in()).join(drops, "__row_id", "left").withColumn("text", cut("text", "__row_keys")).filter(F.col("__row_keys").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("__row_keys").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return got.select(docs.columns)
