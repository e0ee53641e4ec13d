"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be off by k = RATE * n edits. Cut into k + 1
pieces, one piece at least is untouched in any such copy, so exact hits of the
pieces (one Aho-Corasick pass over each text) give every candidate place; each
is then verified with Myers' bit-parallel edit distance, one machine word step
for each character of the place.

Texts are compared in lower case with white space as one space. Defined results:
null, empty or blank texts hold nothing, and such items are in no text. An item of
fewer than SHORT characters has no error budget and counts only where it stands
between word bounds (its letters occur anywhere). Texts of any length are searched
whole. Repeated rows give the
same rows again; item ids that repeat with different texts are told apart by
text, and the least distance counts; ties don't arise. A null doc_id stays null; a null item_id
counts as an item like any other. Other columns are ignored. Empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_out, id_text, rows, schema_of

RATE = 0.05
SHORT = 24
#: Bytes of test items sent to the executors at once; more items go in further passes.
BLOCK_BYTES = 2 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def at_word_bounds(text: str, a: int, b: int) -> bool:
    """Whether no letter or digit on either side goes on into text[a:b]."""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b - 1].isalnum() and text[b].isalnum())


def myers(masks: dict[str, int], m: int, text: str) -> int:
    """The least edit distance of the pattern to any substring of ``text``."""
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
    return best


class Matcher:
    def __init__(self, items: list[str], rate: float = RATE):
        """``items``: normal texts, each once."""
        import ahocorasick

        self.items, self.budget, self.masks, self.tree = items, [int(rate * len(x)) if len(x) >= SHORT else 0 for x in items], {}, ahocorasick.Automaton()
        for j, x in enumerate(items):
            n = self.budget[j] + 1
            for p in range(n):
                a, b = p * len(x) // n, (p + 1) * len(x) // n
                self.tree.get(x[a:b], None) or self.tree.add_word(x[a:b], [])
                self.tree.get(x[a:b]).append((j, b))
        if items:
            self.tree.make_automaton()

    def _distance(self, j: int, text: str) -> int:
        x = self.items[j]
        if j not in self.masks:
            masks: dict[str, int] = {}
            for i, c in enumerate(x):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks[j] = masks
        return myers(self.masks[j], len(x), text)

    def find(self, text: str) -> dict[int, int]:
        """Item to its least distance in ``text``, where within the budget."""
        if not self.items:
            return {}
        places: dict[int, set[int]] = {}
        for end, hits in self.tree.iter(text):
            for j, b in hits:
                places.setdefault(j, set()).add(end + 1 - b)
        found = {}
        for j, starts in places.items():
            x, k = self.items[j], self.budget[j]
            if len(x) < SHORT:
                starts = {s for s in starts if at_word_bounds(text, s, s + len(x))}
            if any(s >= 0 and text.startswith(x, s) for s in starts):
                found[j] = 0
                continue
            best, stretch = k + 1, None
            for s in [*sorted(starts), None]:
                if stretch and s is not None and s - k <= stretch[1]:
                    stretch = (stretch[0], s + len(x) + k)
                    continue
                if stretch and k:
                    best = min(best, self._distance(j, text[max(0, stretch[0]) : stretch[1]]))
                stretch = s is not None and (s - k, s + len(x) + k)
            if best <= k:
                found[j] = best
        return found


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): each item that a document holds within its
    budget of ``rate`` edits a character, with the least number of edits."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // block_bytes + 1
    own, out, ddl = id_text(docs), schema_of("doc_id long,item_id long,distance long"), "doc_id long, item_id long, distance long"
    got = spark.createDataFrame([], ddl)
    for n in range(blocks):  # the items of a block fit one broadcast; texts are read once for each block
        by_text: dict[str, set] = {}
        for r in bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == n).collect():
            if x := normal(r["text"]):
                by_text.setdefault(x, set()).add(r["item_id"])
        sent = spark.sparkContext.broadcast([(x, list(i)) for x, i in sorted(by_text.items())])

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher, ids = Matcher([x for x, _ in sent.value], rate), [i for _, i in sent.value]
            for b in batches:
                hits = [(d, i, n) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for j, n in matcher.find(normal(t)).items() for i in ids[j]]
                yield rows(out, *(list(zip(*hits)) or [[]] * 3))

        got = got.unionByName(own.mapInArrow(find, ddl))
    return got.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance")).withColumn("doc_id", id_out())
