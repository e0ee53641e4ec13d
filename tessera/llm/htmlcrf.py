"""Main-text extraction with a linear-chain conditional random field over the
leaf blocks of a page's DOM.

A block's features are the tags and class words of its ancestors (near and far)
and signs of its text: length, share of links, end mark, digits, place. Two
labels (article, rest) with transition weights; trained by maximum likelihood
(forward-backward, L2) on labelled pages, decoded by Viterbi. Extraction is a
narrow pass over whole pages with a model of fixed size.

Defined results: null, empty or blank html, and pages without an article, have
the empty text. Null urls and ids stay null; repeated rows give a row each; pages of
any length are read whole; of labellings with the same score the first found counts;
other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, schema_of, ready
from .dom import Block, blocks
from .pagemaker import labelled_page

#: Pages a model is trained on, and weight of the L2 penalty.
TRAINING_PAGES, PENALTY = 700, 0.1
_PARTS = frozenset("article main section aside nav header footer form head dialog figure".split())
_END = frozenset(".!?:;…»”\"'")


def features(b: Block, place: int, n: int) -> list[str]:
    words, tags = b.text.count(" ") + 1, [t for t, _ in b.path]
    out = ["1", f"w{min(6, words.bit_length())}", f"l{int(4 * b.links / len(b.text))}", f"at{4 * place // n}", "end" if b.text[-1] in _END else "open"]
    if "©" in b.text or "copyright" in b.text.lower():
        out.append("©")
    digits = sum(map(str.isdigit, b.text))
    out.append(f"d{int(3 * digits / len(b.text))}")
    out.append(f"w{min(6, words.bit_length())}l{b.links > len(b.text) / 2}")
    if tags:
        out.append("own=" + tags[-1])
    out.append("part=" + next((t for t in reversed(tags) if t in _PARTS), "none"))
    for t in set(tags):
        out.append("in=" + t)
    for depth, (t, names) in enumerate(reversed(b.path)):
        for x in names:
            out.append(f"name={x}")
            if depth < 3:
                out.append(f"near={x}")
        if depth < 3:
            out.append(f"near<{t}")
    return list(dict.fromkeys(out))


@dataclass
class ChainCRF:
    """Weight of each feature for label 1 over label 0, and of transitions."""

    weight: dict[str, float]
    step: np.ndarray
    first: float
    last: float

    def label(self, page: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        n, get = len(page), self.weight.get
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, 0.0, []
        for i, block in enumerate(page):
            e = sum(get(f, 0.0) for f in features(block, i, n))
            if i:
                back.append((a + s00 < b + s10, a + s01 < b + s11))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
            else:
                b = self.first + e
        now = int(b + self.last > a)
        out = [now]
        for choice in reversed(back):
            now = int(choice[now])
            out.append(now)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], penalty: float = PENALTY, steps: int = 200) -> ChainCRF:
    """pages: features of each block, and labels."""
    pages = [p for p in pages if p[1]]
    names = {f: i for i, f in enumerate(dict.fromkeys(f for x, _ in pages for b in x for f in b))}
    n, m = len(pages), max(len(y) for _, y in pages)
    size = np.array([len(y) for _, y in pages])
    there = np.arange(m) < size[:, None]
    gold = np.zeros((n, m), np.int64)
    row, col = [], []
    for p, (x, y) in enumerate(pages):
        gold[p, : len(y)] = y
        for t, fs in enumerate(x):
            row += [p * m + t] * len(fs)
            col += [names[f] for f in fs]
    row, col = np.array(row), np.array(col)
    k = len(names)
    theta, mean, var = np.zeros(k + 6), np.zeros(k + 6), np.zeros(k + 6)
    final = size - 1
    at = np.arange(n)
    for it in range(1, steps + 1):
        w, step, first, last = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4], theta[k + 5]
        e = np.zeros((n, m, 2))
        e[:, :, 1] = np.bincount(row, w[col], n * m).reshape(n, m)
        e[:, 0, 1] += first
        e[at, final, 1] += last
        alpha, beta = np.zeros((n, m, 2)), np.zeros((n, m, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, m):
            alpha[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + e[:, t], alpha[:, t - 1])
        for t in range(m - 2, -1, -1):
            beta[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[at, final], axis=1)
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * there
        d = p1 - gold * there
        g = np.zeros(k + 6)
        g[:k] = np.bincount(col, d.ravel()[row], k)
        for i in range(2):
            for j in range(2):
                pair = np.exp(alpha[:, :-1, i] + step[i, j] + e[:, 1:, j] + beta[:, 1:, j] - z[:, None]) * there[:, 1:]
                g[k + 2 * i + j] = pair.sum() - ((gold[:, :-1] == i) & (gold[:, 1:] == j) & there[:, 1:]).sum()
        g[k + 4], g[k + 5] = d[:, 0].sum(), d[at, final].sum()
        g = g + penalty * theta
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        theta = theta - 0.1 * (1 - it / (steps + 1)) * (mean / (1 - 0.9**it)) / (np.sqrt(var / (1 - 0.99**it)) + 1e-6)
    return ChainCRF({f: float(theta[i]) for f, i in names.items()}, theta[k : k + 4].reshape(2, 2), float(theta[k + 4]), float(theta[k + 5]))


def labelled_blocks(seed: int) -> tuple[list[Block], list[int]]:
    """Blocks of a training page with their labels: each text is wrapped in
    marks that survive parsing and tell its label."""
    html = "".join(x if y is None else f"{chr(0xE000 + y)}{x}{chr(0xE002)}" for x, y in labelled_page(seed))
    got, labels = [], []
    for b in blocks(html):
        # A text cut in two by a tag inside keeps the label of its start.
        mark = next((ord(c) - 0xE000 for c in b.text if c in ""), None)
        clean = " ".join(b.text.translate({0xE000: None, 0xE001: None, 0xE002: None}).split())
        if clean:
            got.append(Block(clean, b.path, min(b.links, len(clean))))
            labels.append(mark if mark is not None else labels[-1] if labels else 0)
    return got, labels


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> ChainCRF:
    data = []
    for seed in range(pages):
        b, y = labelled_blocks(seed)
        data.append(([features(x, i, len(b)) for i, x in enumerate(b)], y))
    return train(data)


def extract(pages: DataFrame, model: ChainCRF | None = None) -> DataFrame:
    """(page_id, url, text, n_blocks, n_main) for each row of ``pages``
    (page_id, url, html): the article's blocks, joined by two newlines."""
    ready(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    ddl = "page_id long, url string, text string, n_blocks long, n_main long"
    out = schema_of(ddl.replace(", ", ","))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, main = [], [], []
            for html in b.column(2).to_pylist():
                found = blocks(html or "")
                kept = [x.text for x, y in zip(found, sent.value.label(found)) if y]
                texts.append("\n\n".join(kept))
                total.append(len(found))
                main.append(len(kept))
            yield rows(out, b.column(0), b.column(1), texts, total, main)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(per_batch, ddl)
