import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from tessera.llm import merkle as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, leaf string, level int"


def h(*xs):
    return sha256("".join(xs).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, k):
    got = []
    for level in tree[:-1]:
        a = k // 3 * 3
        got.append((level[a:k], level[k + 1 : a + 3]))
        k //= 3
    return got


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(table):
    """By the contract's words, on lists."""
    by = defaultdict(list)
    for i, text, lang, source, n in table:
        leaf = h(*map(field, (i, source, lang, n, text)))
        gone = text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        by[source].append((i, leaf, h(*map(field, (i, source, lang, n, text.replace("\n", "")))) if gone else leaf))
    key = lambda s: (s is not None, (s or "").encode())
    order = sorted(by, key=key)
    trees = {s: levels([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    root, want = top[-1][0], []
    for j, s in enumerate(order):
        for k, (i, leaf, other) in enumerate(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            path = siblings(trees[s], k) + siblings(top, j)
            d = other
            for left, right in path:
                d = h(*left, d, *right)
            want.append((i, leaf, trees[s][-1][0], root, h(*(x for a, b in path for x in a + b)), d, d == root))
    return want


def rows(n_by_source):
    got, i = [], 0
    for s, n in n_by_source:
        for _ in range(n):
            got.append((i * 7 % 100_003, f"line {i}\nof {s}\n" * (i % 3), "en", s, i % 5 or None))
            i += 1
    return got


CASES = {
    "one": rows([("a", 1)]),
    "sources": rows([(f"s{k}", k % 12) for k in range(30)] + [(None, 4), ("", 3), ("ü", 5), ("z", 100)]),
    "odd": rows([("a", 28)]) + [(None, "x\ny", "de", "a", 1), (None, None, None, "a", None), (None, "x\ny", "de", "a", 1), (14, "copy\n", "de", "a", 1), (14, "copy\n", "de", "a", 1), (500, "", "fr", None, 0), (501, "long \n" * 50_000, "fr", None, 0)],
}


@pytest.mark.parametrize("case, height, limit", [("one", 7, 100_000), ("sources", 7, 100_000), ("odd", 7, 100_000), ("sources", 2, 4), ("odd", 1, 1)])
def test_equals_the_rule(spark, case, height, limit):
    docs = spark.createDataFrame([(*x, "t", 1, "l", 2) for x in CASES[case]], DOCS).repartition(3)
    got = M.manifest(docs, height, limit)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(CASES[case]), key=repr)


def test_empty_table(spark):
    assert M.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_queue_writes_runs_and_keeps_order():
    import random
    random.seed(3)
    q, items = M.MessageQueue(50), [((random.randrange(40), "x"), (random.randrange(9),)) for _ in range(3000)]
    done = []
    for k, (label, item) in enumerate(items):
        q.push(label, item)
        if k % 3 == 0:
            done.append((q.first(), q.pop()))
    rest = []
    while q:
        rest.append((q.first(), q.pop()))
    assert rest == sorted(rest) and sorted(done + rest) == sorted(items)


def test_depth():
    assert [M.depth(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
