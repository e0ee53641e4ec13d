"""Quality rules with an n-gram perplexity model.

A document fails the base rules if it is short or repeats itself; the others are
judged by their perplexity per sign under a model of their language: an
interpolated modified Kneser-Ney model (Chen and Goodman, 1999) of ORDER signs.
The signs are those of the text's words, one space between two, and an end mark, so
n-grams cross word bounds and see the order of words.

The first pass counts n-grams over whole texts: a task merges sorted arrays of
64-bit hashes, one hash for each distinct n-gram, and Spark sums the counts of all
tasks. Continuation counts, discounts and back-off weights follow by further
groupings, and joins of each order with the next lower one give every n-gram its
probability. The model is kept as sorted arrays of the n-grams' hashes with their
log probabilities, all languages together (a hash starts from its language). It
grows with the distinct n-grams of the input; executors get it in parts of at
most PART n-grams, one after the other, and each part costs one read of the texts
whose n-grams it has. In 64 bits, 10**8 n-grams have one collision with a chance
of 3 in 10**4.

A language has two bands, for log perplexity per word and per sign. An edge lies
so many spreads from the median of documents that pass the base rules; a spread is
the distance from the median to the 16th or the 84th percentile, of deviations
times the square root of the length (see ``deviation``), since means of short
texts vary more. The lower edges reject what repeats what the language says most often (menus, lists),
the upper ones signs, codes and other languages. Documents outside fail.

Defined results: a null text has no words; a text without words fails by the
base rules. A null lang is a language of its own. Repeated rows are judged each
and count each; null ids stay null. Texts of any length count whole; ties on an
edge are inside. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, id_in, id_out, rows, schema_of, ready, stored

ORDER = 5
#: Spreads from the median to the lower and the upper edge, per word and per sign.
BANDS = {"log_ppl": (2.5, 3.0), "log_ppl_sign": (4.0, 2.75)}
#: The least spread of a deviation times the square root of the length.
LEAST_SPREAD = 0.1
#: Words, and signs, from which on a longer text is hardly surer than a shorter one.
LONG = {"n_words": 1000.0, "n_signs": 6000.0}
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1 << 20
#: Signs that a task hashes at once.
SIGNS = 1 << 20
#: n-grams of the model (12 bytes each) that executors hold at once.
PART = 1 << 22
#: Languages whose bands are sent to all executors; more are joined.
LANGUAGES = 10_000
_PAD, _END = "\x02", "\x03"
SYMBOLS = b"#*$%&|<>"
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def signs(words: list[bytes]) -> np.ndarray:
    """The code points of a text's words with its pads and end mark."""
    text = _PAD * (ORDER - 1) + b" ".join(words).decode("utf-8", "replace") + _END
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def language_seed(lang: str) -> np.uint64:
    import xxhash
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def gram_hashes(code: np.ndarray, seed) -> np.ndarray:
    """A 64-bit hash of each ORDER signs in a row; ``seed``: of the language, or
    one for each row."""
    n = max(0, len(code) - ORDER + 1)
    h = np.empty(n, np.uint64)
    h[:] = seed
    wide = code.astype(np.uint64) * _MIX
    for j in range(ORDER):
        h ^= wide[j : j + n]
        h *= _STEP
        h ^= h >> np.uint64(29)
    return h


def stretches(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """About SIGNS signs of ``texts`` at a time: (signs end to end, whether an
    n-gram begins at each place, the texts in it, where the first n-gram of each
    begins). A longer text comes in several stretches, each n-gram in one."""
    held, of, size = [], [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - ORDER + 1), SIGNS):
            held.append(t[a : a + SIGNS + ORDER - 1])
            of.append(k)
            size += len(held[-1])
            if size >= SIGNS:
                yield _stretch(held, of)
                held, of, size = [], [], 0
    if held:
        yield _stretch(held, of)


def _stretch(held: list[np.ndarray], of: list[int]):
    ends = np.cumsum([len(t) for t in held])
    inside = np.ones(max(0, ends[-1] - ORDER + 1), bool)
    for k in range(1, ORDER):  # n-grams that reach into the next text
        inside[ends[:-1] - k] = False
    return np.concatenate(held), inside, np.array(of), ends - [len(t) for t in held]


class GramCounts:
    """Distinct n-grams of one language: hashes (sorted), counts, signs."""

    def __init__(self, seed: np.uint64):
        self.seed, self.hashes, self.counts, self.signs = seed, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32)

    def add(self, texts: list[np.ndarray]) -> None:
        """Count the n-grams of texts, given as ``signs``."""
        for code, inside, _, _ in stretches(texts):
            h, place = gram_hashes(code, self.seed), np.flatnonzero(inside)
            order = np.argsort(h[place])
            place = place[order]
            h = h[place]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            counts = np.diff(np.append(first, len(h)))
            place = place[first]
            self._merge(h[first], counts, np.stack([code[place + j] for j in range(ORDER)], 1))

    def _merge(self, hashes: np.ndarray, counts: np.ndarray, signs: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        within = at < len(self.hashes)
        known[within] = self.hashes[at[within]] == hashes[within]
        self.counts[at[known]] += counts[known]
        new = ~known
        self.hashes = np.insert(self.hashes, at[new], hashes[new])
        self.counts = np.insert(self.counts, at[new], counts[new])
        self.signs = np.insert(self.signs, at[new], signs[new], 0)

    def grams(self) -> list[str]:
        text = self.signs.astype("<u4").tobytes().decode("utf-32-le")
        return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def gram_counts(own: DataFrame) -> DataFrame:
    """own (doc_id, text, lang) to (lang, gram, c): distinct n-grams with their
    counts, as each task finds them."""
    out = schema_of("lang string,gram string,c long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, GramCounts] = {}

        def flush(lang: str) -> pa.RecordBatch:
            got = held.pop(lang)
            return rows(out, [lang] * len(got.hashes), got.grams(), got.counts)

        for b in batches:
            texts: dict[str, list] = {}
            for t, lang in zip(encoded(b.column(1)), b.column(2).to_pylist()):
                if words := t.split():
                    texts.setdefault(lang, []).append(signs(words))
            for lang, own_texts in texts.items():
                held.setdefault(lang, GramCounts(language_seed(lang))).add(own_texts)
                if len(held[lang].hashes) > HELD:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    return own.mapInArrow(count, "lang string, gram string, c long")


def _level(counts: DataFrame, n: int) -> DataFrame:
    """counts (lang, gram, c) of order n to (lang, gram, p, back): (c - D) / total
    and the weight its context leaves for the next lower order."""
    by = counts.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    ratio = lambda a, b, k: F.when((F.col(a) > 0) & (F.col(b) > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(b) / F.col(a)))).otherwise(F.lit(0.5 * k))
    discounts = stored(by.select("lang", ratio("n1", "n2", 1).alias("d1"), ratio("n2", "n3", 2).alias("d2"), ratio("n3", "n4", 3).alias("d3")), "discounts")
    if discounts.count() <= LANGUAGES:
        discounts = F.broadcast(discounts)
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = counts.join(discounts, "lang").select("lang", "gram", F.expr(f"substring(gram, 1, {n - 1})").alias("ctx"), F.col("c").cast("double").alias("c"), d.alias("d"))
    totals = cut.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    return cut.join(totals, ["lang", "ctx"]).select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("p"), (F.col("left") / F.col("total")).alias("back"))


def fit(counts: DataFrame) -> DataFrame:
    """counts (lang, gram, c) of n-grams of ORDER signs to (lang, gram, log_p):
    the log probability of each n-gram's last sign after the others."""
    levels = [stored(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")]
    for _ in range(ORDER - 1):
        # How many signs an n-gram follows: its count in the next lower order.
        levels.append(stored(levels[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")), "grams"))
    model, lower = None, F.lit(1.0 / max(2, levels[-1].count()))
    for n, level in enumerate(reversed(levels), 1):
        own = _level(level, n)
        if model is not None:
            own, lower = own.withColumn("end", F.expr("substring(gram, 2)")).join(model.select("lang", F.col("gram").alias("end"), F.col("p").alias("low_p")), ["lang", "end"]), F.col("low_p")
        model = stored(own.select("lang", "gram", (F.col("p") + F.col("back") * lower).alias("p")), "model")
    return model.select("lang", "gram", F.log(F.greatest("p", F.lit(1e-12))).alias("log_p"))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text holds twice or more. Windows
    are told apart by 64-bit hashes."""
    n = len(words)
    if n < 4:
        return 0
    code = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    window = ((code[:-2] * _MIX ^ code[1:-1]) * _STEP ^ code[2:]) * _MIX
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int32)
    hit = np.isin(window, twice)
    edge[:-3] += hit
    edge[3:] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


class SortedArrays:
    """Log probabilities by hash: sorted hashes, and where each leading run of
    bits begins among them."""

    def __init__(self, hashes: np.ndarray, log_p: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.log_p = hashes[order], log_p[order]
        self.shift = np.uint64(64 - max(1, int(len(hashes)).bit_length()))
        heads = np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift
        self.starts = np.searchsorted(self.hashes, heads).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The log probability of each hash; 0 for those of other parts."""
        out = np.zeros(len(h))
        at, left, last = self.starts[h >> self.shift], np.arange(len(h)), len(self.hashes) - 1
        while len(left):
            left = left[at <= last]
            at = at[at <= last]
            own, asked = self.hashes[at], h[left]
            same = own == asked
            out[left[same]] = self.log_p[at[same]]
            on = own < asked
            left, at = left[on], at[on] + 1
        return out


def sorted_arrays(model: DataFrame) -> DataFrame:
    """(hash, log_p) of a model (lang, gram, log_p); hash as a signed number."""
    out = schema_of("hash long,log_p float")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, np.uint64] = {}
        for b in batches:
            if b.num_rows:
                langs = b.column("lang").to_pylist()
                seeds |= {x: language_seed(x) for x in set(langs) if x not in seeds}
                code = np.frombuffer("".join(b.column("gram").to_pylist()).encode("utf-32-le"), "<u4")
                seed = np.repeat(np.array([seeds[x] for x in langs], np.uint64), ORDER)[: len(code) - ORDER + 1]
                yield rows(out, gram_hashes(code, seed)[::ORDER].view(np.int64), b.column("log_p").to_numpy().astype(np.float32))

    return model.mapInArrow(hashes, "hash long, log_p float")


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_KEY = ["doc_id", "lang", "text_hash"]


def _scored(own: DataFrame, part, measures: bool) -> DataFrame:
    """(doc_id, lang, text_hash, log) of each row of ``own`` (doc_id, text, lang):
    the sum of what ``part`` says of the text's n-grams; with ``measures`` also
    what the base rules ask."""
    names = _MEASURES if measures else ["n_words"]
    ddl = "doc_id long, lang string, text_hash long, " + ", ".join(f"{m} long" for m in names) + ", n_signs long, log double"
    out = schema_of(ddl.replace(", ", ","))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seeds = SortedArrays(*part.value), {}
        for b in batches:
            langs, got, texts, of = b.column(2).to_pylist(), [], [], []
            for k, t in enumerate(encoded(b.column(1))):
                words, chars = t.split(), 0
                if words:
                    code = signs(words)
                    texts.append(code)
                    of.append(k)
                    chars = len(code) - ORDER - len(words) + 1
                got.append((len(words), chars, len(t) - len(t.translate(None, SYMBOLS)), repeated_lines(t), repeated_words(words)) if measures else (len(words),))
            seeds |= {x: language_seed(x) for x in set(langs) if x not in seeds}
            seed_of = np.array([seeds[langs[k]] for k in of], np.uint64)
            n, log = np.zeros(len(langs), np.int64), np.zeros(len(langs))
            for code, inside, mine, starts in stretches(texts):
                sizes = np.diff(np.append(starts, len(code)))
                h = gram_hashes(code, np.repeat(seed_of[mine], sizes)[: len(inside)])
                h[~inside] = 0
                found = np.where(inside, model.find(h), 0.0)
                rows_of = np.array(of)[mine]
                np.add.at(log, rows_of, np.add.reduceat(found, starts))
                np.add.at(n, rows_of, sizes - ORDER + 1)
            yield rows(out, b.column(0), langs, b.column(3), *(list(zip(*got)) or [[]] * len(names)), n, log)

    return own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(score, ddl)


def measure(own: DataFrame, part: int | None = None) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_signs, log_ppl, log_ppl_sign) for each row of ``own`` (doc_id, text, lang)."""
    spark = own.sparkSession
    model = stored(sorted_arrays(fit(gram_counts(own))), "arrays")
    parts = max(1, -(-model.count() // (part or PART)))
    got, more = None, None
    for k in range(parts):
        mine = model.filter(F.pmod(F.shiftrightunsigned("hash", 32), F.lit(parts)) == k).toArrow()
        sent = spark.sparkContext.broadcast((mine["hash"].to_numpy().view(np.uint64), mine["log_p"].to_numpy()))
        if got is None:
            got = _scored(own, sent, True)
        else:  # rows that agree in id, language and text have the same sum
            own_part = stored(_scored(own, sent, False).groupBy(*_KEY).agg(F.max("log").alias("log")), "part")
            more = own_part if more is None else more.unionByName(own_part)
    if more is not None:
        more = more.groupBy(*_KEY).agg(F.sum("log").alias("more"))
        got = got.join(more, _KEY, "left").withColumn("log", F.col("log") + F.coalesce("more", F.lit(0.0)))
    per = lambda n: F.when(F.col("n_words") > 0, -F.col("log") / F.col(n))
    return got.select("doc_id", "lang", *_MEASURES, "n_signs", per("n_words").alias("log_ppl"), per("n_signs").alias("log_ppl_sign"))


def bands(seen: DataFrame) -> DataFrame:
    """(lang, and for each measure its median, spread below and spread above) over
    the documents of ``seen`` that pass the base rules."""
    own, q = seen.filter("not base_failed"), lambda c, at: F.percentile_approx(c, at, 10_000)
    mid = own.groupBy("lang").agg(*[q(m, 0.5).alias(f"{m}_mid") for m in BANDS])
    mid = stored(mid, "medians")
    off = own.join(F.broadcast(mid) if mid.count() <= LANGUAGES else mid, "lang")
    spread = [q(deviation(m), [0.16, 0.84]).alias(m) for m in BANDS]
    wide = off.groupBy("lang").agg(*spread)
    sides = [F.greatest((F.lit(s) * F.col(m)[k]), F.lit(LEAST_SPREAD)).alias(f"{m}_{n}") for m in BANDS for k, n, s in ((0, "below", -1.0), (1, "above", 1.0))]
    return mid.join(wide.select("lang", *sides), "lang")


def deviation(measure: str):
    """How far a document is from its language's median, in units that don't
    depend on its length: a mean over n words varies as 1 / sqrt(n) from chance,
    and for very long texts as documents do among themselves."""
    n = "n_words" if measure == "log_ppl" else "n_signs"
    return (F.col(measure) - F.col(f"{measure}_mid")) * F.sqrt(F.col(n) / (1 + F.col(n) / LONG[n]))


def judge(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, edges: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    log_ppl, log_ppl_sign, base_failed, kept) for each row of ``docs`` (doc_id,
    text, lang). ``edges``: spreads to the lower and the upper edge of each band."""
    ready(docs.sparkSession)
    # A tag no language has stands for null.
    own = docs.select(id_in().alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("\x00")).alias("lang"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    seen = stored(measure(own).withColumn("base_failed", failed), "measured")
    known = stored(bands(seen), "bands")
    if known.count() <= LANGUAGES:
        known = F.broadcast(known)
    kept = ~F.col("base_failed")
    for m, (low, high) in edges.items():
        kept &= F.coalesce(deviation(m).between(-low * F.col(f"{m}_below"), high * F.col(f"{m}_above")), F.lit(False))
    return seen.join(known, "lang", "left").select(id_out().alias("doc_id"), *_MEASURES, "log_ppl", "log_ppl_sign", "base_failed", kept.alias("kept"))
