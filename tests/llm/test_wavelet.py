import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tessera.llm import wavelet as V
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def shard(monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 64)
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.4, 1000), 4000).astype(np.uint16)
    counts = np.array([1, 0, 399, 600])
    return ids, V.WaveletShard(V.write_shard(ids, np.array([-3, 5, 5, 9]), counts, 12, part=1, seq=2))


def test_access_count_and_occurrences(shard):
    ids, got = shard
    assert got.decode().tolist() == ids.tolist() == [got.access(i) for i in range(1000)]
    seen = Counter(ids.tolist())
    for token in [*list(seen)[:40], 0, 4095, 5000]:
        at = np.flatnonzero(ids == token)
        assert got.count(token) == seen[token]
        assert got.occurrences(token).tolist() == at.tolist()
        assert got.occurrences(token, 1, 3).tolist() == at[1:3].tolist()
        for a, b in [(0, 64), (63, 65), (128, 999), (1000, 1000)]:
            assert got.count(token, a, b) == (ids[a:b] == token).sum()
    assert got.doc_ids.tolist() == [-3, 5, 5, 9] and got.header["seq"] == 2
    assert got.document(2).tolist() == ids[1:400].tolist() and got.document(1).tolist() == []
    with pytest.raises(IndexError):
        got.access(1000)
    with pytest.raises(ValueError):
        V.WaveletShard(b"something else")


def test_empty_shard_and_compression():
    none = V.WaveletShard(V.write_shard(np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64), 16))
    assert none.decode().tolist() == [] and none.count(2) == 0 and none.occurrences(2).tolist() == []
    same = V.write_shard(np.full(300_000, 7, np.uint16), np.array([1]), np.array([300_000]), 16)
    assert len(same) < 30_000 and V.WaveletShard(same).count(7, 100_000, 200_000) == 100_000


@pytest.mark.parametrize("size", [5, 300, 1 << 20])
def test_round_trip_equals_the_tokenizer(spark, make, tmp_path, size):
    one = Tokenizer.from_file(PATH)
    pairs = [(i, f"House {i} and the tea, {'x' * (i % 5)}!") for i in range(60, 0, -1)]
    pairs += [(None, "no id"), (100, None), (101, ""), (102, "long text " * 2000), (7, "Another seven"), (7, "Another seven"), (103, "\n \t")]
    got = V.round_trip(make(pairs), PATH, folder=f"{tmp_path}/s", shard_tokens=size).collect()
    want, at = [], 0
    key = lambda p: -1 if p[0] is None else p[0]
    ids = lambda t: one.encode(t or "", add_special_tokens=False).ids + [2]
    for i, t in sorted(pairs, key=key):
        if i != 7:
            want.append((i, at, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())))
        at += len(ids(t))
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got]
    assert sorted((x for x in rows if x[0] != 7), key=key) == want
    sevens = sorted((x for x in rows if x[0] == 7), key=lambda x: x[1])
    assert sorted(x[3] for x in sevens) == sorted(zlib.crc32(np.array(ids(t), "<u4").tobytes()) for i, t in pairs if i == 7)
    before = next(x for x in rows if x[0] == 6)
    assert sevens[0][1] == before[1] + before[2] and all(a[1] + a[2] == b[1] for a, b in zip(sevens, sevens[1:]))
    found = V.token_occurrences(spark, f"{tmp_path}/s", [2]).count()
    assert found == len(pairs)


def test_empty_table(make):
    got = V.round_trip(make([]), PATH)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0
