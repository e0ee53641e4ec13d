import math
import random
import re
from collections import Counter

import pytest
from tessera.llm import lexsearch as L

ITEMS = "item_id long, text string, term int, score int, rank string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=20):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    N, T = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    want = []
    for q, text in items:
        found = []
        for i, w, c in held:
            m = 100 - 25 + 25 * len(w) * N // T
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0:
                found.append((-s, i is not None, i or 0))
        want += [(q, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k])]
    return want


def case():
    rng = random.Random(4)
    vocab = [f"w{n}" for n in range(60)] + ["Éa", "éa", "don't", "naïve", "日本", "x_y", "THE"]
    text = lambda n: rng.choice([" ", "\n", "-", "\x7f"]).join(rng.choice(vocab[: rng.randint(3, len(vocab))]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(300)]
    docs += [(None, "w1 w2 the"), (900, None), (901, ""), (902, "w1 rare " * 4000), (903, "...\n"), (5, docs[5][1]), (950, docs[5][1]), (951, docs[5][1]), (904, "a\x00b")]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(100, "rare rare THE the"), (101, None), (102, ""), (103, "absent words"), (None, "w3 naïve"), (7, "w1 w2"), (104, "w1 " * 300)]
    return docs, items


@pytest.mark.parametrize("cells, block", [(1 << 21, 1 << 22), (40, 60)])
def test_equals_brute_force(spark, make, monkeypatch, cells, block):
    monkeypatch.setattr(L, "CELLS", cells)
    docs, items = case()
    asked = spark.createDataFrame([(*x, 1, 2, "r") for x in items], ITEMS)
    got = L.search(make(docs), asked, 6, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(docs, items, 6), key=repr)


def test_heaps_keep_the_least_id_of_equal_scores():
    import numpy as np
    h = L.Heaps(1, 3)
    for ids in ([9, 8, 1], [7, 2, 6], [0, 5, 4]):
        h.update(np.full((3, 1), 5), ids)
    assert sorted(h) == [(0, 0, 5), (0, 1, 5), (0, 2, 5)]


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "tea house", 1, 2, "r")], ITEMS)
    for docs, items in ((make([]), some), (make([(1, "tea")]), none), (make([(1, "")]), some)):
        got = L.search(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
