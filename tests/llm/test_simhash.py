import random
import re

import numpy as np
import pytest
import xxhash
from tessera.llm.components import components
from tessera.llm.simhash import covering_masks, fingerprint, links, near_duplicates

UP = {i: i + 32 for i in range(65, 91)}


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, near):
    up = {i: i for i in ids}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_every_pair_within_the_radius_shares_a_table():
    masks, turn = [m & (1 << 64) - 1 for m in covering_masks(4)], random.Random(5)
    assert len(masks) == 31
    for _ in range(3000):
        d = sum(1 << i for i in turn.sample(range(64), turn.randint(0, 4)))
        assert any(not d & m for m in masks)


def texts():
    turn = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(turn.choices(words, k=turn.randint(1, 120))) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    for n in range(60):
        w = turn.choice(base).split()
        w[turn.randrange(len(w))] = "edit%d" % n
        out.append((100 + n, " ".join(w)))
    return out + [(200, None), (201, ""), (202, " \n\t"), (203, base[0].upper()), (None, base[3]), (5, base[5]), (204, "éÉ Straße Ñ"), (205, "one two"), (206, "ONE  two\n"), (207, "long words " * 20000)]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_components_against_brute_force(make, bucket):
    pairs = texts()
    low = -(1 << 62)
    own = {low if i is None else i: plain(t) for i, t in pairs}
    want = classes(sorted(own), lambda a, b: (own[a] ^ own[b]).bit_count() <= 4)
    got = near_duplicates(make(pairs), bucket=bucket).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == sorted(
        (repr(i), "%016x" % own[low if i is None else i], repr(None if want[low if i is None else i] == low else want[low if i is None else i])) for i, _ in pairs)


def test_large_buckets_link_as_small_ones_do(spark):
    turn = random.Random(9)
    base = [turn.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << i for i in turn.sample(range(64), turn.randint(0, 7))) for b in base for _ in range(40)})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for bucket in (4096, 2):
        comps = {r.id & (1 << 64) - 1: r.component for r in components(links(df, 4, bucket)).collect()}
        group = {}
        for x in fps:
            group.setdefault(comps.get(x, ("alone", x)), set()).add(x)
        assert {frozenset(g) for g in group.values()} == {frozenset(x for x in fps if want[x] == r) for r in set(want.values())}


def test_components_of_a_long_path_and_an_empty_graph(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 901), (5, 5)], "a long, b long"))
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(make):
    assert near_duplicates(make([])).count() == 0


def test_fingerprint_of_short_texts():
    assert fingerprint(b"") == 0 and fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)
