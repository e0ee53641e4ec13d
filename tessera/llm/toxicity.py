"""Toxicity classifier with counterfactual regularisation.

Features are indicators of words and of the runs of four and five letters in
them, the word's bounds included. Spark counts each in toxic and other documents over all labelled rows that
are not held out; the FEATURES with the clearest ratio, and those of identity
terms, make the model's input. A logistic model is then fitted on a bounded
sample of rows. For each of these, a sentence in which identity terms are
swapped for those of other groups (in a sentence without any, one is put in)
gives a counterfactual row, and the square of the change of its score is
penalised: a mention of a group as such can't raise a score (Garg et al., 2019).

Scoring is a narrow pass over whole texts with a model of bounded size. Defined
results: null, empty and blank texts score by the intercept. Without a label of
each class every score is the share of label 1 (0.5 without labels). Rows that
repeat a doc_id are scored each by its own text; null ids stay null and learn
nothing. Words and texts of any length are taken whole; features with equal
ratios are taken by their number. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, id_out, id_text, rows, schema_of, sigmoid
from .labelled import training_texts

#: Labelled rows to fit on at most; hashed features; features of the model.
SAMPLE, DIM, FEATURES = 8000, 1 << 22, 4096
#: Lengths of the runs of letters.
RUNS = (4, 5)
#: Standard errors by which a feature's share in toxic documents is higher at least.
CLEAR = 5.0
#: Terms that name groups of people, swapped for one another; a parameter.
IDENTITY = ["women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "blacks", "whites", "asians", "latinos", "arabs", "africans", "europeans",
            "immigrants", "refugees", "gays", "lesbians", "transgender", "straight", "disabled", "deaf", "blind", "elderly", "teenagers",
            "frauen", "männer", "muslime", "christen", "juden", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "mujeres", "hombres", "musulmanes", "cristianos", "judíos"]
_EDGES = b".,;:!?\"'()[]{}*#%&$|<>"


class _Grams(dict):
    """Word to its hashed features: the word and its runs of letters. Long words
    are not kept."""

    def __missing__(self, word: bytes) -> list[int]:
        h = hashed(word)
        if len(word) <= 64:
            self[word] = h
        return h


def hashed(word: bytes) -> list[int]:
    if not word:
        return []
    w = "^" + word.decode("utf-8", "ignore") + "$"
    found = {w[i : i + n] for n in RUNS for i in range(len(w) - n + 1)}
    return [crc32(word) % DIM, *(crc32(x.encode(), 1) % DIM for x in found)]


def words_of(text: bytes) -> set[bytes]:
    return {w.strip(_EDGES) for w in set(text.decode("utf-8", "replace").lower().encode().split())}


@dataclass
class Model:
    """Sorted feature ids with their weights."""

    ids: np.ndarray
    weight: np.ndarray
    bias: float
    _known: dict = field(default_factory=dict, repr=False)
    _at: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"ids": self.ids, "weight": self.weight, "bias": self.bias, "_known": {}, "_at": {}}

    def rows_of(self, words: set[bytes]) -> np.ndarray:
        """The model's features among the words', as positions in ``ids``."""
        known, at = self._known, self._at
        if len(known) > 1_000_000:
            known.clear()
        if not at:
            at.update((int(x), i) for i, x in enumerate(self.ids))
        got: set[int] = set()
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = tuple({at[h] for h in hashed(w) if h in at})
            if k:
                got.update(k)
        return np.array(sorted(got), np.int64)

    def score(self, text: bytes) -> float:
        return float(sigmoid(self.weight[self.rows_of(words_of(text))].sum() + self.bias))


def counterfactual(text: str, turn: int, identity: list[str] = IDENTITY) -> str:
    """``text`` with every identity term swapped for another, the same for the
    same; if it has none, with one put into its first sentence."""
    known = {t: i for i, t in enumerate(identity)}
    other = lambda i: identity[(i + 1 + turn % (len(identity) - 1)) % len(identity)]
    words = re.split(r"(\W+)", text)
    if any(w.lower() in known for w in words):
        return "".join(other(known[w.lower()]) if w.lower() in known else w for w in words)
    return f"{identity[turn % len(identity)]} {text}"


def feature_counts(labelled: DataFrame) -> DataFrame:
    """labelled (doc_id, text, y) to (feature, pos, neg): documents of each
    class that have it; each task sends a row for each feature it met."""
    out = schema_of("feature int,pos long,neg long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = _Grams(), [np.zeros(DIM, np.int32), np.zeros(DIM, np.int32)]
        for b in batches:
            for t, y in zip(encoded(b.column(1)), b.column(2).to_pylist()):
                if len(grams) > 200_000:
                    grams.clear()
                own = np.unique(np.fromiter((h for w in words_of(t) for h in grams[w]), np.int64))
                total[0 if y else 1][own] += 1
        some = np.flatnonzero(total[0] + total[1])
        for part in np.array_split(some, len(some) // 50_000 + 1):
            yield rows(out, part, total[0][part], total[1][part])

    return labelled.mapInArrow(count, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def logistic(x: list[np.ndarray], y: np.ndarray, change: list[tuple[np.ndarray, np.ndarray]], dim: int, ridge: float = 2e-5, fairness: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Full-batch accelerated projected gradient descent on log loss + ridge *
    |w|^2 + fairness * (score change of each counterfactual)^2, with weights of
    at least 0: what speaks for toxicity counts, nothing makes up for it."""
    def flat(rows_):
        return np.repeat(np.arange(len(rows_)), [len(r) for r in rows_]), np.concatenate([*rows_, np.zeros(0, np.int64)]).astype(np.int64)

    (r, c), (ra, ca), (rb, cb), n = flat(x), flat([a for a, _ in change]), flat([b for _, b in change]), len(y)
    w = v = np.zeros(dim)
    bias = vb = 0.0
    moved = np.mean([len(np.setxor1d(a, b)) for a, b in change] or [0.0])
    rate = 1.0 / (np.mean([len(i) + 1 for i in x]) / 4 + 2 * fairness * moved + 2 * ridge)  # over the greatest curvature
    for k in range(steps):
        p = sigmoid(np.bincount(r, v[c], n) + vb)
        d = np.bincount(ra, v[ca], n) - np.bincount(rb, v[cb], n)
        g = np.bincount(c, (p - y)[r], dim) / n + 2 * ridge * v + 2 * fairness / n * (np.bincount(ca, d[ra], dim) - np.bincount(cb, d[rb], dim))
        new, nb = np.maximum(v - rate * g, 0.0), vb - rate * float((p - y).mean())
        v, vb = new + k / (k + 3) * (new - w), nb + k / (k + 3) * (nb - bias)
        w, bias = new, nb
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", identity: list[str] = IDENTITY, sample: int = SAMPLE, n_features: int = FEATURES, fairness: float = 1.0) -> Model:
    """Counts cover all labelled rows that are not held out; the logistic fit
    takes at most ``sample`` of them."""
    counts = feature_counts(training_texts(docs, labels, column))
    totals = training_texts(docs, labels, column).groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in totals}
    if not n.get(1) or not n.get(0):
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    # How far the share in toxic documents lies above that in others, in standard errors.
    p, q = F.col("pos") / n[1], F.col("neg") / n[0]
    both = (F.col("pos") + F.col("neg")) / (n[0] + n[1])
    clear = (p - q) / F.sqrt(both * (1 - both) * (1 / n[1] + 1 / n[0]) + 1e-12)
    top = counts.filter((F.col("pos") + F.col("neg") >= 3) & (clear >= CLEAR)).orderBy(F.desc(clear), "feature").limit(n_features).collect()
    grams = _Grams()
    own = {g for t in identity for g in grams[t.encode()]}
    shell = Model(np.array(sorted({r["feature"] for r in top} | own), np.int64), np.zeros(len(own | {r["feature"] for r in top})), 0.0)
    out, ddl = schema_of("doc_id long,y int,plain array<int>,other array<int>"), "doc_id long, y int, plain array<int>, other array<int>"
    sent = docs.sparkSession.sparkContext.broadcast(shell)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            ids, texts = b.column(0).to_pylist(), encoded(b.column(1))
            yield rows(out, ids, b.column(2), [m.rows_of(words_of(t)) for t in texts], [m.rows_of(words_of(counterfactual(t.decode("utf-8", "replace"), i % 9973, identity).encode())) for i, t in zip(ids, texts)])

    got = training_texts(docs, labels, column, sample).mapInArrow(extract, ddl).collect()
    got.sort(key=lambda r: (r["doc_id"], r["plain"]))
    x = [np.array(r["plain"], np.int64) for r in got]
    w, bias = logistic(x, np.array([r["y"] for r in got], float), [(a, np.array(r["other"], np.int64)) for a, r in zip(x, got)], len(shell.ids), fairness=fairness)
    return Model(shell.ids, w, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    out, sent = schema_of("doc_id long,score double"), docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(out, b.column(0), [sent.value.score(t) for t in encoded(b.column(1))])

    return id_text(docs).mapInArrow(judge, "doc_id long, score double").withColumn("doc_id", id_out())
