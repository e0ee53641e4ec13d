"""Tokenization as corpus jobs.

* ``pretokenize`` — GPT-4-style split with Spark's (Java) regex engine.
* ``train_bpe`` — byte-level BPE over the table of *distinct* pieces with
  their counts: shards with an inverted index from pairs to places, whose
  merges change pair counts instead of counting again.
* ``encode_corpus`` — narrow: the texts of an Arrow batch are split and merged
  together in slices, so no token-level shuffle or join is needed and hot
  pieces cost nothing extra.
* ``decode_tokens`` — one-row broadcast of the vocabulary map (bounded by
  the vocabulary size) and a narrow ``transform``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import SPECIAL_TOKENS
from .bpe import PieceMerger, PieceShard, best_pair, encode_piece, pair, predict

# Fixed value: the pre-tokenizer split pattern (numbers in groups of at most 2).
SPLIT_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
JAVA_PATTERN = "(?U)" + SPLIT_PATTERN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pieces_col(text) -> Column:
    """array<string> of pre-tokens; they concatenate back to the text."""
    return F.regexp_extract_all(_c(text), F.lit(JAVA_PATTERN), 0)


def pretokenize(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, piece) rows."""
    return docs.select(key, F.posexplode(pieces_col(text)).alias("pos", "piece"))


def pretoken_counts(pieces: DataFrame, piece: str = "piece") -> DataFrame:
    """Frequency of each distinct piece (partial aggregation before the shuffle)."""
    return pieces.groupBy(piece).agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------------ BPE training

#: Bytes of pieces in one shard of the training state.
SHARD_BYTES = 4 << 20
#: Most frequent pieces on the driver, from which the next merges are guessed.
SAMPLE_PIECES = 20_000
#: Pairs whose counts are known exactly in a round.
CANDIDATES = 4096
#: Merges that a round does again on the stored shards before these are stored anew.
REPLAYED = 512


def _start_shards(batches):
    """(piece, count) rows to shards of the training state and their pair counts."""
    def out(pieces, counts):
        s = PieceShard(pieces, counts)
        pairs, n = s.pair_counts()
        return _round_rows(s.dump(), [(-1, pairs, n)])

    pieces, counts, size = [], [], 0
    for b in batches:
        for p, c in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
            pieces.append(p)
            counts.append(c)
            size += len(p)
            if size >= SHARD_BYTES:
                yield out(pieces, counts)
                pieces, counts, size = [], [], 0
    if pieces:
        yield out(pieces, counts)


def _round_rows(state: bytes | None, changes: list):
    """The state, unless it is None, and the changes of pair counts by step."""
    n, k = sum(len(p) for _, p, _ in changes), int(state is not None)
    step = np.concatenate([np.full(k, -1, np.int32), *(np.full(len(p), s, np.int32) for s, p, _ in changes)])
    pairs = np.concatenate([np.zeros(k, np.int64), *(p for _, p, _ in changes)])
    by = np.concatenate([np.zeros(k, np.int64), *(d for _, _, d in changes)])
    return pa.RecordBatch.from_arrays(
        [pa.array([True] * k + [False] * n), pa.array([state] * k + [None] * n, pa.binary()), pa.array(step),
         pa.array(pairs), pa.array(by)], ["is_state", "state", "step", "pair", "change"])


def _run_round(done: list, guessed: list, store: bool):
    """Of stored shards after the merges ``done``: how each of ``guessed``, one
    after the other, would change the pair counts. ``store``: the shards too."""
    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                s = PieceShard.load(blob)
                for a, c, new in done:
                    s.merge(a, c, new)
                state = s.dump() if store else None
                yield _round_rows(state, [(i, *s.merge(a, c, new)) for i, (a, c, new) in enumerate(guessed)])
    return run


def train_bpe(counts: DataFrame, vocab_size: int, n_special: int = len(SPECIAL_TOKENS),
              piece: str = "piece", count: str = "count", guesses: int = 32) -> DataFrame:
    """Merges ``(rank, left_id, right_id, new_id, pair_count)``.

    ``vocab_size − n_special − 256`` merges, each the pair with the highest
    count (ties: smallest (left, right)). Adjacent pairs are counted at every
    position, so in ``aaa`` the pair (a, a) counts twice but is merged once,
    left to right.

    The distinct pieces lie in shards with an inverted index from pairs to
    their places (``PieceShard``), so a merge touches only the pieces that hold
    it and returns the changes of the pair counts; counts are never made anew.
    A round guesses the next merges from a sample, lets every shard try them in
    turn, sums the changes by Spark, and keeps the merges that were the best
    pair at their turn by exact counts (the first always is). The result is that
    of one merge at a time, in a fraction of the passes. Changes of a round are
    written to the shared folder, so lineage stays one round long. Shards are
    stored as pieces and counts, and a round does the merges so far again, which
    costs less than writing links and index each time; after ``REPLAYED`` merges
    they are stored as they are then.
    The driver holds the sample, the top ``CANDIDATES`` pairs and the changes of
    ``guesses`` merges, which the size of the vocabulary bounds.
    """
    import uuid

    from ..session import scratch_path

    spark = counts.sparkSession
    root = scratch_path(spark, f"bpe-{uuid.uuid4().hex[:10]}")
    n_merges = max(0, vocab_size - n_special - 256)
    schema = "is_state boolean, state binary, step int, pair long, change long"
    own = counts.select(F.col(piece).alias("piece"), F.col(count).cast("bigint").alias("count")).filter(F.length("piece") > 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.partitionBy("is_state").parquet(f"{root}/{name}")
        return spark.read.schema(schema).parquet(f"{root}/{name}")

    own.write.parquet(f"{root}/pieces")
    own = spark.read.parquet(f"{root}/pieces")
    rnd = written(own.repartition(parts, "piece").mapInArrow(_start_shards, schema), "0")
    top_pieces = own.orderBy(F.desc("count"), "piece").limit(SAMPLE_PIECES).collect()
    sample = PieceShard([r["piece"].encode() for r in top_pieces], [r["count"] for r in top_pieces]).dump()
    changes = rnd.filter("not is_state").select("pair", "change")
    merges: list[tuple] = []
    done: list[tuple[int, int, int]] = []
    shards, since = rnd.filter("is_state").select("state"), []
    while len(merges) < n_merges:
        ranked = changes.groupBy("pair").agg(F.sum("change").alias("n")).filter("n > 0").orderBy(F.desc("n"), "pair")
        exact = {r["pair"]: r["n"] for r in ranked.limit(CANDIDATES).collect()}
        if not exact:
            break
        # a pair outside the list counts no more than its last one, and can only lose
        floor = min(exact.values()) if len(exact) == CANDIDATES else 0
        trial = PieceShard.load(sample)
        for m in done:
            trial.merge(*m)
        sample = trial.dump()
        guessed = predict(trial, exact, 256 + len(merges), min(guesses, n_merges - len(merges)))
        since = since + done
        store = len(since) >= REPLAYED
        rnd = written(shards.mapInArrow(_run_round(since, guessed, store), schema), str(len(merges) + 1))
        if store:
            shards, since = rnd.filter("is_state").select("state"), []
        seen: list[dict[int, int]] = [{} for _ in guessed]
        tried = rnd.filter("not is_state").select("step", "pair", "change")
        for r in tried.groupBy("step", "pair").agg(F.sum("change").alias("d")).collect():
            seen[r["step"]][r["pair"]] = r["d"]
        done = []
        for i, (a, b, new) in enumerate(guessed):
            best = best_pair(exact)
            if best is None or exact[best] <= 0 or pair(best) != (a, b) or (i and exact[best] <= floor):
                break
            merges.append((len(merges), a, b, new, exact[best]))
            done.append((a, b, new))
            for c, d in seen[i].items():
                if c in exact or new in pair(c):
                    exact[c] = exact.get(c, 0) + d
        changes = changes.unionByName(tried.filter(F.col("step") < len(done)).select("pair", "change"))
    return spark.createDataFrame(merges, "rank int, left_id int, right_id int, new_id int, pair_count long")


def build_vocab(merges: DataFrame, specials: list[str] | None = None) -> DataFrame:
    """(token_id, token binary, is_special): bytes 0–255, merges by rank,
    specials last. Token bytes follow merge order, so the (vocabulary-sized)
    merge list is folded on the driver."""
    specials = list(SPECIAL_TOKENS if specials is None else specials)
    rows = merges.orderBy("rank").collect()
    tok = {i: bytes([i]) for i in range(256)}
    for m in rows:
        tok[m["new_id"]] = tok[m["left_id"]] + tok[m["right_id"]]
    out = [(i, tok[i], False) for i in sorted(tok)]
    nxt = max(tok) + 1
    out += [(nxt + j, s.encode(), True) for j, s in enumerate(specials)]
    return merges.sparkSession.createDataFrame(out, "token_id int, token binary, is_special boolean")


def _ranks(vocab_rows) -> dict[bytes, int]:
    return {bytes(r["token"]): r["token_id"] for r in vocab_rows if not r["is_special"]}


bpe_encode_piece = encode_piece
#: Bytes of pieces and their ids that a Python worker keeps between batches, twice.
CACHE_BYTES = 32 << 20


class PieceCache(dict):
    """piece to its ids as bytes, found when first asked for. The pieces met last
    and those before them are kept; ids don't depend on it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.before, self.size = ranks, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.pop(piece, None)
        if ids is None:
            ids = array("i", encode_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
        self.size += len(piece) + len(ids) + 150
        self[piece] = ids
        return ids

    def trim(self) -> None:
        if self.size > CACHE_BYTES:
            self.before = dict(self)
            self.clear()
            self.size = 0


#: Characters of texts that a Python worker encodes at a time.
SLICE_CHARS = 1 << 16
_LETTER, _SPACE, _LINE, _STOP, _SIGN = 1, 2, 3, 4, 5
#: Kinds of bytes: ASCII letters, space, line ends, punctuation; digits and "'"; all others 0.
_KINDS = np.array([_LETTER if chr(b).isalpha() else _SPACE if b == 32 else _LINE if b in b"\r\n" else _SIGN if chr(b).isdigit() or b == 39
                   else _STOP if 32 < b < 127 else 0 for b in range(128)] + [0] * 128, np.uint8)


def piece_starts(data: np.ndarray, first: np.ndarray, find) -> np.ndarray:
    """Where the pieces of texts start that lie end to end as UTF-8; ``first``: where
    texts do, none of them empty.

    No piece goes on from a sign that isn't white space into a space, and the
    split only looks ahead: a text may be cut before such spaces, and the parts
    split by themselves. Parts of ASCII letters and punctuation, with a space
    only before them, are split by the kinds of neighbours; others by ``find``."""
    kind = _KINDS[data]
    text = np.zeros(len(data), bool)
    text[first] = True
    prev, prev2, follow = np.append(0, kind[:-1]), np.append([0, 0], kind[:-2])[: len(kind)], np.append(kind[1:], 0)
    part = text | (kind == _SPACE) & ((prev == _LETTER) | (prev == _STOP) | (prev == _SIGN))
    ended = np.append(part[1:], True)
    odd = (kind == 0) | (kind == _SIGN) | (kind == _SPACE) & (~part | (follow == _LINE) & ~ended)
    # one mark joins letters after it, several don't, nor does one after a space
    own = np.append(False, ~part[:-1]) & ((prev2 == _STOP) | (prev2 == _SPACE))
    starts = part | (kind == _LETTER) & ((prev == _LINE) | (prev == _STOP) & own) \
        | (kind == _LINE) & (prev == _LETTER) | (kind == _STOP) & ((prev == _LETTER) | (prev == _LINE))
    at = np.flatnonzero(part)
    bad = np.logical_or.reduceat(odd, at)
    # parts to search, neighbours of one text together
    begin = bad & ~(np.append(False, bad[:-1]) & ~text[at])
    end = bad & ~(np.append(bad[1:], False) & ~np.append(text[at[1:]], True))
    bounds = np.append(at, len(data))
    raw, sizes = data.tobytes(), []
    for a, b in zip(bounds[:-1][begin].tolist(), bounds[1:][end].tolist()):
        found = find(region := raw[a:b].decode())
        sizes += map(len, found if len(region) == b - a else [p.encode() for p in found])
    if sizes:  # pieces cover what was searched
        searched = np.flatnonzero(np.repeat(bad, np.diff(bounds)))
        starts[searched] = False
        starts[searched[np.cumsum([0, *sizes[:-1]])]] = True
    return starts


class TextEncoder:
    """Ids of texts, as bytes; many texts at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        self.find, self.pieces, self.merger = regex.compile(SPLIT_PATTERN).findall, PieceCache(ranks), PieceMerger(ranks)

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return [b""] * len(texts)
        at = np.flatnonzero(piece_starts(data, (ends - sizes)[sizes > 0], self.find))
        ids, counts = self.merger.encode(data, at)
        until = 4 * np.append(0, np.cumsum(counts))[np.searchsorted(at, np.append(0, ends))]
        ids = ids.tobytes()
        return [ids[a:b] for a, b in zip(until[:-1].tolist(), until[1:].tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        out: list = [None] * len(texts)
        some, chars = [], 0
        for i, t in enumerate(texts):
            if t is not None and self.merger.table is None:
                out[i] = b"".join(map(self.pieces.__getitem__, self.find(t)))
            elif t is not None:
                some.append(i)
                chars += len(t)
            if chars >= SLICE_CHARS:
                for k, ids in zip(some, self._slice([texts[k].encode() for k in some])):
                    out[k] = ids
                some, chars = [], 0
        if some:
            for k, ids in zip(some, self._slice([texts[k].encode() for k in some])):
                out[k] = ids
        self.pieces.trim()
        return out


def encode_corpus(docs: DataFrame, vocab: DataFrame, text: str = "text", prepend: int | None = None,
                  append: int | None = None, out: str = "ids") -> DataFrame:
    """Ordinary encoding (special strings in the text are plain text).

    The vocabulary is collected once (bounded by the vocabulary size) and
    shipped as a broadcast variable. Only the text crosses into Python and only ids come back.
    """
    return docs.withColumn(out, bpe_encoder(docs.sparkSession, _ranks(vocab.collect()), prepend, append)(_c(text)))


def bpe_encoder(spark, ranks: dict[bytes, int], prepend: int | None = None, append: int | None = None):
    """A column function: text to array<int> of ids."""
    bc = spark.sparkContext.broadcast(ranks)
    head = b"" if prepend is None else prepend.to_bytes(4, "little")
    tail = b"" if append is None else append.to_bytes(4, "little")

    @F.arrow_udf("array<int>")
    def enc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = TextEncoder(bc.value)
        for batch in texts:
            got = [None if g is None else head + g + tail for g in cache.encode(batch.to_pylist())]
            sizes = np.array([len(g or b"") // 4 for g in got])
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            values = pa.array(np.frombuffer(b"".join(g or b"" for g in got), "<i4"))
            yield pa.ListArray.from_arrays(ends, values, mask=pa.array([g is None for g in got]))

    return enc


class BpeCodec:
    """A trained vocabulary behind the codec interface of ``ByteCodec``. It merges
    across what texts are put together from, so ids of a concatenation aren't the
    concatenated ids (``kind``): see ``option_spans_items``."""

    kind = "bpe"

    def __init__(self, vocab: DataFrame):
        rows = vocab.collect()  # vocabulary sized
        self.spark, self.table = vocab.sparkSession, vocab
        self.ranks = _ranks(rows)
        self.specials = {bytes(r["token"]).decode(): r["token_id"] for r in rows if r["is_special"]}
        self._encode = bpe_encoder(self.spark, self.ranks)

    def special(self, name: str) -> int:
        return self.specials[name if name.startswith("<|") else f"<|{name}|>"]

    @property
    def bos(self) -> int:
        return self.special("bos")

    def encode_col(self, text) -> Column:
        return self._encode(_c(text))

    def length_col(self, text) -> Column:
        return F.size(self.encode_col(text))

    def encode(self, df: DataFrame, text: str, out: str = "ids") -> DataFrame:
        return df.withColumn(out, self.encode_col(text))

    def vocab(self, spark) -> DataFrame:
        return self.table

    def option_spans(self, kind: str):
        """A column function of (before, options, after): an array with the ids,
        start and end of each option, see ``option_spans_items``."""
        return _spans_udf(self.spark, self.ranks, self.bos, kind)


def seam_texts(before: str, options: list[str], after: str) -> tuple[str, list[str], str]:
    """What no option touches at the start, what lies between for each option, and
    what no option touches at the end, cut where a text may be (``piece_starts``)."""
    cut = before.rfind(" ")
    while cut > 0 and before[cut - 1].isspace():
        cut = before.rfind(" ", 0, cut)
    cut = max(cut, 0)
    first = re.search(r"(?<=\S) ", after)
    rest = first.start() if first else len(after)
    return before[:cut], [before[cut:] + o + after[:rest] for o in options], after[rest:]


def seam_ids(find, encode, before: str, options: list[str], after: str) -> list[tuple[np.ndarray, int, int]]:
    """Of each option: the ids of ``before + option + after``, and how many ids at
    the start and at the end come from pieces that no option touches. These are
    split and encoded once."""
    def ids(text):
        return b"".join([encode(m.group()) for m in find(text)])
    start, middles, end = seam_texts(before, options, after)
    head, tail = ids(start), ids(end)
    return [(np.frombuffer(head + ids(m) + tail, "<i4"), len(head) // 4, len(tail) // 4) for m in middles]


def _shared(ids: list[np.ndarray]) -> int:
    """Ids that all sequences begin with in common."""
    n = min(map(len, ids))
    for x in ids[1:]:
        n = min(n, int(np.argmin(np.append(ids[0][:n] == x[:n], False))))
    return n


def _spans_udf(spark, ranks: dict[bytes, int], bos: int, kind: str):
    bc = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<struct<ids:array<int>,start:int,end:int>>")
    def spans(before: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache, first = TextEncoder(bc.value), np.int32(bos).tobytes()
        for b, o, a in before:
            seams = [seam_texts(x, options, y) for x, options, y in zip(b.to_pylist(), o.to_pylist(), a.to_pylist())]
            texts = iter(cache.encode([t for x, middles, y in seams for t in (x, *middles, y)]))
            ids, sizes, starts, counts = [], [], [], []
            for _, middles, _ in seams:
                head = first + next(texts)
                between = [next(texts) for _ in middles]
                tail = next(texts)
                got = [np.frombuffer(head + m + tail, "<i4") for m in between]
                if got:
                    common = _shared(got) if kind == "mc" else _shared([g[::-1] for g in got])
                    starts += [common if kind == "mc" else len(g) - common for g in got]
                ids += got
                sizes += [len(g) for g in got]
                counts.append(len(got))
            ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            inner = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
            rows = pa.StructArray.from_arrays([inner, pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], ["ids", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), rows)

    return spans


def decode_tokens(df: DataFrame, ids: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """ids → bytes → text; specials dropped, malformed UTF-8 and ids that the
    vocabulary doesn't have → U+FFFD. The vocabulary is one broadcast row: an
    array with the bytes of each id, looked up by position."""
    hexed = F.when(F.col("is_special"), F.lit("")).otherwise(F.hex("token"))
    known = vocab.agg(F.map_from_entries(F.collect_list(F.struct("token_id", hexed))).alias("_m"), F.max("token_id").alias("_top"))
    table = known.select(F.transform(F.sequence(F.lit(0), F.col("_top")), lambda i: F.try_element_at("_m", i)).alias("_hex"))
    j = df.withColumn("_k", F.lit(1)).join(F.broadcast(table.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row
    hx = F.array_join(F.transform(F.col(ids), lambda i: F.coalesce(F.when(i >= 0, F.get(F.col("_hex"), i)), F.lit("EFBFBD"))), "")
    return j.withColumn(out, F.make_valid_utf8(F.unhex(hx).cast("string"))).drop("_hex")


# ------------------------------------------------------------------ word codec


#: Words of a vocabulary that every executor gets; a larger one is joined.
WORDS_SENT = 2_000_000


def _word_ids(words: Column, df: DataFrame, vocab: DataFrame, unk: int) -> Column:
    sent = df.sparkSession.sparkContext.broadcast({r["word"]: r["id"] for r in vocab.select("word", "id").collect()})

    @F.arrow_udf("array<int>")
    def look(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = sent.value.get
        for b in rows:
            ids = [get(w, unk) for w in b.flatten().to_pylist()]
            sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(b).to_pylist()])
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids, pa.int32()))

    return look(words)


def word_encode(df: DataFrame, col: str, vocab: DataFrame, key: str, sos: int = 1, eos: int = 2,
                unk: int = 0, out: str = "ids") -> DataFrame:
    """Lower-case, split on white space, look up (unknown = 0), wrap in SOS/EOS.

    A vocabulary of at most ``WORDS_SENT`` words goes to the executors and rows
    are looked up where they are, without a shuffle. A larger one is joined with
    the distinct words of each row, which are then put back in place.
    """
    split = F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    wrap = lambda body: F.concat(F.array(F.lit(sos)), body, F.array(F.lit(eos)))
    if vocab.limit(WORDS_SENT + 1).count() <= WORDS_SENT:
        return df.withColumn(out, wrap(_word_ids(split, df, vocab, unk)))
    d = df.withColumn("_w", split)
    e = d.select(key, F.explode(F.array_distinct("_w")).alias("word")).distinct()
    g = e.join(vocab.select("word", F.col("id").alias("_id")), "word").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "_id"))).alias("_m"))
    known = lambda w: F.coalesce(F.try_element_at(F.col("_m"), w), F.lit(unk))
    return d.join(g, key, "left").withColumn(out, wrap(F.transform("_w", known))).drop("_w", "_m")


# ------------------------------------------------------------------ evaluation of codecs


def compression_ratio(encoded: DataFrame, by: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """UTF-8 bytes per token per group."""
    g = encoded.groupBy(*by).agg(F.sum(F.octet_length(text)).cast("bigint").alias("bytes"),
                                 F.sum(F.size(ids)).cast("bigint").alias("tokens"))
    return g.withColumn("ratio", F.col("bytes") / F.col("tokens"))


def compare_tokenizers(base: DataFrame, ours: DataFrame, by: list[str]) -> DataFrame:
    """Relative token difference (base − ours)/base·100 and the better ratio."""
    b = base.select(*by, F.col("bytes"), F.col("tokens").alias("base_tokens"), F.col("ratio").alias("base_ratio"))
    o = ours.select(*by, F.col("tokens").alias("ours_tokens"), F.col("ratio").alias("ours_ratio"))
    j = b.join(o, by)
    better = (F.when(F.col("base_ratio") > F.col("ours_ratio"), F.lit("base"))
               .when(F.col("ours_ratio") > F.col("base_ratio"), F.lit("ours")).otherwise(F.lit("tie")))
    return j.withColumn("relative_diff_pct", (F.col("base_tokens") - F.col("ours_tokens")) / F.col("base_tokens") * 100) \
            .withColumn("better", better)


def tokenizer_roundtrip(encoded: DataFrame, decoded_col: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """Count of rows whose decode(encode(text)) differs from the text; with
    ``ids`` the number of tokens from the same pass."""
    size = [] if ids is None else [F.sum(F.size(ids)).cast("bigint").alias("n_tokens")]
    return encoded.agg(F.count(F.lit(1)).alias("n_docs"),
                       F.count_if(~F.col(decoded_col).eqNullSafe(F.col(text))).alias("n_mismatch"), *size)
