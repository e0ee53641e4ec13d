"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of n-grams (one to three) of word shapes: runs of
letters and digits become one sign for their kind, other signs stay, and a word
equal to the one before becomes a sign of its own. An indicator is scaled by the
log ratio of its counts in the two classes; on these a linear hinge-loss model is
fitted by dual coordinate descent (Hsieh et al., 2008), pulled towards naive
Bayes by interpolation, and its margin is made a probability by Platt's sigmoid.

Fitting takes a bounded sample of labelled rows (SAMPLE); scoring is a narrow
pass over whole texts with a model of fixed size. Defined results: null, empty
and blank texts have no n-gram and score by the intercept. Without a label of
each class every score is the share of label 1 (0.5 without labels). Rows that
repeat a doc_id are scored each by its own text; null ids stay null and learn
nothing. Words and texts of any length count whole; ties in the sample's order go to
the lower id. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, id_out, id_text, rows, schema_of, sigmoid
from .labelled import training_texts

#: Labelled rows to fit on at most, and hashed features.
SAMPLE, DIM = 6000, 1 << 18
_KINDS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m.group().isupper() and len(m.group()) > 1 else "a"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"(.)\1+"), lambda m: m.group(1) * 2)]


class _Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        s = word.decode("utf-8", "replace")
        for pattern, sign in _KINDS:
            s = pattern.sub(sign, s)
        h = xxhash.xxh32_intdigest(s.encode())
        if len(word) <= 64:
            self[word] = h
        return h


_SHAPES = _Shapes()
_AGAIN = xxhash.xxh32_intdigest(b"again")


def features(text: bytes) -> np.ndarray:
    """The sorted hashed n-grams of a text."""
    if len(_SHAPES) > 100_000:
        _SHAPES.clear()
    words = text.split()
    if not words:
        return np.zeros(0, np.int32)
    s = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, len(words))
    s[1:][np.fromiter(map(bytes.__eq__, words, words[1:]), bool, len(words) - 1)] = _AGAIN
    two = s[:-1] * np.uint64(0x9E3779B1) + s[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + s[2:] * np.uint64(0x27D4EB2F) + np.uint64(2)
    grams = np.unique(np.concatenate([s, two, three]))
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((grams >> np.uint64(40)) % np.uint64(DIM)).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, grams: np.ndarray) -> float:
        return float(sigmoid(self.slope * (self.weight[grams].sum() + self.bias) + self.shift))


def hinge_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 12) -> np.ndarray:
    """Dual coordinate descent for the L1 hinge loss with L2 regularisation:
    rows (index, value), labels of -1 and 1, a cost for each row."""
    w, alpha, turn = np.zeros(dim), np.zeros(len(y)), np.random.default_rng(7)
    norm = np.array([v @ v for _, v in x])
    for _ in range(epochs):
        moved = 0.0
        for i in turn.permutation(len(y)):
            j, v = x[i]
            if not norm[i]:
                continue
            g = y[i] * (w[j] @ v) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[j] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid, by Newton steps on smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    p = np.array([1.0, 0.0])
    a = np.c_[margin, np.ones(len(margin))]
    for _ in range(50):
        s = sigmoid(a @ p)
        h = (a * (s * (1 - s))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (s - target) + 1e-3 * (p - [1, 0]))
        p = p - np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(p[0]), float(p[1])


def fit_rows(grams: list[np.ndarray], y: np.ndarray, beta: float = 0.5, cost: float = 1.0, smooth: float = 1.0) -> Model:
    y = np.asarray(y, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(DIM), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    count = np.full((2, DIM), smooth)
    for g, k in zip(grams, y):
        count[k, g] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    sign, size = np.where(y > 0, 1.0, -1.0), np.bincount(y, minlength=2)
    costs = cost * len(y) / (2 * size[y])
    # The last index is the intercept; rows have unit length but for it.
    def row(g):
        v = ratio[g]
        return np.append(g, DIM), np.append(v / max(np.sqrt(v @ v), 1e-9), 1.0)

    x = [row(g) for g in grams]
    fold = np.arange(len(y)) % 5 == 4
    if not (0 < y[fold].sum() < fold.sum()) or y[~fold].min() == y[~fold].max():
        fold = np.zeros(len(y), bool)
    own = np.flatnonzero(~fold)
    w = hinge_descent([x[i] for i in own], sign[own], costs[own], DIM + 1)
    w[:DIM] = (1 - beta) * np.abs(w[:DIM]).mean() + beta * w[:DIM]
    check = np.flatnonzero(fold) if fold.any() else own
    margin = np.array([w[x[i][0]] @ x[i][1] for i in check])
    return Scaled(w[:DIM] * ratio, float(w[DIM]), *platt(margin, y[check]), ratio)


@dataclass
class Scaled(Model):
    """A model for rows of unit length."""

    ratio: np.ndarray

    def score(self, grams: np.ndarray) -> float:
        length = float(np.sqrt((self.ratio[grams] ** 2).sum()))
        return float(sigmoid(self.slope * (self.weight[grams].sum() / max(length, 1e-9) + self.bias) + self.shift))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows that are not held out."""
    out = schema_of("doc_id long,y int,grams array<int>")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(out, b.column(0), b.column(2), [features(t) for t in encoded(b.column(1))])

    got = training_texts(docs, labels, column, sample).mapInArrow(extract, "doc_id long, y int, grams array<int>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["grams"]))
    return fit_rows([np.array(r["grams"], np.int64) for r in got], np.array([r["y"] for r in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    out, sent = schema_of("doc_id long,score double"), docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows(out, b.column(0), [sent.value.score(features(t)) for t in encoded(b.column(1))])

    return id_text(docs).mapInArrow(judge, "doc_id long, score double").withColumn("doc_id", id_out())
