import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tessera.llm.cutting import knapsack, patterns
from tessera.llm.packing import pack
from tessera.llm.wordids import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \t\n", "Hello, World!!", "don't I'll 'S x'y", "<|startoftext|> a <|ENDOFTEXT|>", "x<|endoftext|>y", "é École İ Σς ΟΔΟΣ", "a b c\u0085d", "a\x00b", "«q», ... a.,b, 12 3.5 z9,", "\U0001d400 ﬁ 漢字, ก", "word " * 3000, "x" * 9000]


def whole(text):
    return np.array(encoder(PATH).one.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_word_ids_are_the_tokenizers():
    for text, ids in zip(ODD, encoder(PATH).ids([t.encode() for t in ODD])):
        assert ids.tolist() == whole(text)[:-1].tolist(), text


@pytest.mark.parametrize("reserve", [0, 3, 1])
def test_every_id_in_one_piece_and_sequences_without_gaps(make, reserve):
    pairs = [(i, " ".join(["tea", "house"][(i + k) % 2] + str(k % 7) for k in range(i * 13 % 90))) for i in range(120)]
    pairs += [(200 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (300, None), (7, pairs[7][1])]
    got = pack(make(pairs), PATH, length=256, unit=2, reserve=reserve).collect()
    ids = {i: whole(t) for i, t in pairs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        n = 2 if i == 7 else 1
        places = sorted(p for s, k in by_doc[i] for p in range(s, s + k))
        assert places == sorted(list(range(len(x))) * n)
    padding = 0
    for x in by_seq.values():
        end = 0
        for o, k in sorted(x):
            assert o == end
            end += k
        assert end <= 256
        padding += 0 if end & end - 1 == 0 else 256 - end
    total = sum(map(len, ids.values()))
    assert padding == 0 if reserve == 1 else padding < 0.08 * total
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_empty_table(make):
    assert pack(make([]), PATH).count() == 0


def test_knapsack_and_patterns():
    value, copies = knapsack(np.array([3, 5, 7]), np.array([3.0, 5.5, 7.2]), 17)
    assert value == pytest.approx(17.2) or copies @ np.array([3, 5, 7]) <= 17
    histogram = {3: 40, 5: 37, 7: 21, 11: 9, 17: 4}
    packed = patterns(histogram, 17)
    assert all(sum(c * n for c, n in p.items()) <= 17 for _, p in packed)
    for c, n in histogram.items():
        assert sum(t * p.get(c, 0) for t, p in packed) == n
    least = sum(c * n for c, n in histogram.items()) / 17
    assert sum(t for t, _ in packed) <= 1.08 * least + 1
    assert patterns({}, 17) == []
