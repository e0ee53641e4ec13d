"""Token ids on disk as wavelet matrices: one compressed file for each shard.

A shard holds the ids of a run of whole documents in one sequence. Bit-plane l of
the wavelet matrix has, for each id in the order that the planes above left, its
l-th highest bit; ids with a 0 then go before those with a 1, both in order
(Claude, Navarro and Ordonez, 2015). With counts of ones before each chunk, rank
and select on the planes give any id, the count of a token in a stretch and the
place of its k-th occurrence without unpacking the rest: a look-up reads one
chunk of each plane.

File: MAGIC, length of the header (u32, little-endian), header (JSON), sections.
Sections, at offsets that the header has: document ids and token counts (zstd),
then each plane's ones before each chunk (u64), ends of its chunks (u64) and its
chunks, each of CHUNK bits and compressed alone (zstd).

Documents are sorted by id through a range shuffle of their ids, so shards follow
the order of doc_id and no task holds more than a shard. Files get their name
from partition and number and are moved into place when whole, so a task that
runs again writes the same file again.

Defined results: a null or empty text is the end id alone. A null doc_id comes
before all others. Rows that repeat a doc_id are documents each, in the order of
their ids' bytes. A text longer than a shard has a shard of its own. Other
columns of the input are ignored. An empty table gives no document.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import encoded, id_out, id_text, ready, rows, schema_of, scratch, stored
from .wordids import encoder

MAGIC = b"TWM1"
#: Bits of a plane that are compressed together.
CHUNK = 1 << 18
#: A shard ends with the document that brings it to so many ids: planes that fit a
#: core's cache are sorted twice as fast. Larger shards make fewer files.
SHARD_TOKENS = 1 << 20
#: Words whose ids a worker keeps (about 200 MB in all): nothing else is in memory then.
KEPT_WORDS = 600_000


def _pack(data: np.ndarray | bytes) -> bytes:
    raw = data if isinstance(data, bytes) else data.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, bits: int, **extra) -> bytes:
    """The file of ``ids`` (each under 2**bits), the documents' ids and numbers
    of tokens; ``extra`` goes into the header."""
    parts, at, zeros, now = [_pack(doc_ids.astype("<i8")), _pack(counts.astype("<u8"))], [], [], ids
    for level in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << level)) != 0
        plane = np.packbits(one, bitorder="little").tobytes()
        chunks = [plane[i : i + CHUNK // 8] for i in range(0, len(plane), CHUNK // 8)]
        ones = np.cumsum([0] + [int(np.bitwise_count(np.frombuffer(c, np.uint8)).sum()) for c in chunks])
        packed = [_pack(c) for c in chunks]
        parts += [ones.astype("<u8").tobytes(), np.cumsum([0] + [len(c) for c in packed]).astype("<u8").tobytes(), b"".join(packed)]
        zeros.append(len(now) - int(ones[-1]))
        now = np.concatenate((np.compress(~one, now), np.compress(one, now)))
    end = 0
    for p in parts:
        at.append([end, len(p)])
        end += len(p)
    header = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "sections": at} | extra).encode()
    return MAGIC + len(header).to_bytes(4, "little") + header + b"".join(parts)


class _Plane:
    def __init__(self, data: memoryview, ones: np.ndarray, ends: np.ndarray, n: int, zeros: int):
        self.data, self.ones, self.ends, self.n, self.zeros = data, ones, ends, n, zeros
        self.chunk = lru_cache(maxsize=4)(self._chunk)

    def _chunk(self, k: int) -> np.ndarray:
        """The bits of chunk k."""
        size = min(CHUNK, self.n - k * CHUNK)
        raw = _unpack(self.data[int(self.ends[k]) : int(self.ends[k + 1])], -(-size // 8))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=size, bitorder="little")

    def bit(self, i: int) -> int:
        return int(self.chunk(i // CHUNK)[i % CHUNK])

    def rank(self, bit: int, i: int) -> int:
        """How many of the first i bits are ``bit``."""
        k, rest = divmod(i, CHUNK)
        one = int(self.ones[k]) + (int(self.chunk(k)[:rest].sum()) if rest else 0)
        return one if bit else i - one

    def select(self, bit: int, which: np.ndarray) -> np.ndarray:
        """The places of the which-th (from 0, ascending) bits that are ``bit``."""
        before = self.ones.astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before), dtype=np.int64) * CHUNK, self.n) - before
        of, out = np.searchsorted(before, which, "right") - 1, np.empty(len(which), np.int64)
        for k in np.unique(of):
            own = of == k
            out[own] = k * CHUNK + np.flatnonzero(self.chunk(int(k)) == bit)[which[own] - before[k]]
        return out

    def mask(self) -> np.ndarray:
        return np.concatenate([self._chunk(k) for k in range(len(self.ends) - 1)] or [np.zeros(0, np.uint8)]).view(bool)


class WaveletShard:
    """Look-ups in the bytes of one file."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(view[4:8], "little")
        self.header, body = json.loads(bytes(view[8 : 8 + size])), view[8 + size :]
        part = [body[a : a + n] for a, n in self.header["sections"]]
        self.n, self.bits, docs = self.header["tokens"], self.header["bits"], self.header["docs"]
        self.doc_ids = np.frombuffer(_unpack(part[0], 8 * docs), "<i8")
        self.counts = np.frombuffer(_unpack(part[1], 8 * docs), "<u8").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.planes = [_Plane(part[3 * k + 4], np.frombuffer(part[3 * k + 2], "<u8"), np.frombuffer(part[3 * k + 3], "<u8"), self.n, self.header["zeros"][k]) for k in range(self.bits)]

    def _bit(self, token: int, level: int) -> int:
        return token >> (self.bits - 1 - level) & 1

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in self.planes:
            b = p.bit(i)
            token, i = token << 1 | b, p.rank(b, i) + b * p.zeros
        return token

    def _stretch(self, token: int, a: int, b: int) -> tuple[int, int]:
        if not 0 <= token < 1 << self.bits:
            return 0, 0
        for level, p in enumerate(self.planes):
            bit = self._bit(token, level)
            a, b = (p.rank(bit, x) + bit * p.zeros for x in (a, b))
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of ``token`` among the ids from place a up to b."""
        x, y = self._stretch(token, a, self.n if b is None else b)
        return y - x

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the occurrences of ``token`` from the ``first`` up to the ``last``."""
        x, y = self._stretch(token, 0, self.n)
        at = np.arange(x, y, dtype=np.int64)[first:last]
        for level in range(self.bits - 1, -1, -1):
            bit, p = self._bit(token, level), self.planes[level]
            at = p.select(bit, at - bit * p.zeros)
        return at

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, with its end id."""
        return np.array([self.access(i) for i in range(int(self.starts[k]), int(self.starts[k] + self.counts[k]))], np.int64)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each puts its zeros and ones back in place."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            p = self.planes[level]
            one, back = p.mask(), np.empty_like(now)
            back[np.flatnonzero(~one)] = now[: p.zeros]  # places are faster than masks here
            back[np.flatnonzero(one)] = now[p.zeros :] | now.dtype.type(1 << (self.bits - 1 - level))
            now = back
        return now


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all; a second attempt puts the same there."""
    fs, base = pafs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    part = f"{base}/.{name}.{context.taskAttemptId() if context else 0}"
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{base}/{name}")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): the ids of each whole text and ``end_id``, little-endian,
    two bytes each where the vocabulary allows it, else four."""
    out = schema_of("doc_id long,ids binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, KEPT_WORDS)
        end = np.array([end_id], enc.kind).tobytes()
        for b in batches:
            yield rows(out, b.column(0), [x.tobytes() + end for x in enc.ids(encoded(b.column(1)))])

    return id_text(docs).mapInArrow(encode, "doc_id long, ids binary")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the token ids of ``docs`` (doc_id, text) to ``folder`` (a folder that
    all executors share, as a URI or an absolute path) in ascending doc_id order.
    Returns the manifest (part, seq, base, n_docs, n_tokens): a row for each
    file, ``base`` being the number of ids in the files before it. ``tokenizer``:
    path of a tokenizers file for which ``wordids`` holds, the same on all
    executors."""
    kind, bits = encoder(tokenizer).kind, int(encoder(tokenizer).one.get_vocab_size() - 1).bit_length()
    held = stored(token_ids(docs, tokenizer, end_id), "ids", "zstd")
    out, ddl = schema_of("part long,seq long,n_docs long,n_tokens long"), "part long, seq long, n_docs long, n_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, doc_ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids, counts = np.frombuffer(b"".join(texts), kind), np.array([len(t) // kind.itemsize for t in texts])
            _put(folder, f"{part:06d}-{seq:06d}.wm", write_shard(ids, np.array(doc_ids, np.int64), counts, bits, part=part, seq=seq))
            return rows(out, [part], [seq], [len(texts)], [len(ids)])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc_ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= shard_tokens * kind.itemsize:
                    yield flush()
                    seq, doc_ids, texts, size = seq + 1, [], [], 0
        if texts:
            yield flush()

    tie = held.withColumn("tie", F.xxhash64("ids"))
    dealt = tie.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
    files = stored(dealt.mapInArrow(cut, ddl), "manifest")
    # Two steps, so that no task has a row of every file.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("base", inside).join(parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("base"), "n_docs", "n_tokens")


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """(content): the bytes of each file, read by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("content")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seq, doc_id, start, n_tokens, ids_crc32) of each document in the
    files; start: its first id within the file."""
    ready(spark)
    ddl = "part long, seq long, doc_id long, start long, n_tokens long, ids_crc32 long"
    out = schema_of(ddl.replace(", ", ","))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = WaveletShard(b.column(0)[i].as_buffer())
                ids = memoryview(shard.decode().astype("<u4")).cast("B")
                crc = [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(shard.starts.tolist(), shard.counts.tolist())]
                n = len(crc)
                yield rows(out, np.full(n, shard.header["part"]), np.full(n, shard.header["seq"]), shard.doc_ids, shard.starts, shard.counts, crc)

    return shard_files(spark, folder).mapInArrow(read, ddl)


def token_occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(part, seq, token, position) of each occurrence of ``tokens`` (a few ids),
    by select on the planes alone."""
    ready(spark)
    out, ddl = schema_of("part long,seq long,token long,position long"), "part long, seq long, token long, position long"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = WaveletShard(b.column(0)[i].as_buffer())
                for token in tokens:
                    at = shard.occurrences(token)
                    n = len(at)
                    yield rows(out, np.full(n, shard.header["part"]), np.full(n, shard.header["seq"]), np.full(n, token), at)

    return shard_files(spark, folder).mapInArrow(find, ddl)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document as the files give
    them after ``docs`` was written to ``folder`` (by default a fresh one under
    the session's shared folder); start: ids of all documents before it."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "shards")
    bases = write_shards(docs, tokenizer, folder, end_id, shard_tokens).select("part", "seq", "base")
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if bases.isEmpty():
        return spark.createDataFrame([], ddl)
    return read_documents(spark, folder).join(bases, ["part", "seq"]).select(id_out().alias("doc_id"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
