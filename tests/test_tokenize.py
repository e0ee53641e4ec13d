import collections
import random
import time

import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tessera.operators import bpe as BPE
from tessera.operators import tokenize as TZ

TEXTS = ["Hello world! Hello there, 12345 apples.", "aaa aaa aaab", "你好世界 🌍 don't", "x　y\u0085z  \t\n end",
         "the the the theme them"]


def py_train(counts: dict[str, int], n_merges: int):
    """Plain BPE: count adjacent pairs at every position, best = (count desc, pair asc)."""
    work = {tuple(p.encode()): c for p, c in counts.items()}
    merges = []
    for r in range(n_merges):
        pc = collections.Counter()
        for ids, c in work.items():
            for a, b in zip(ids, ids[1:]):
                pc[(a, b)] += c
        if not pc:
            break
        (a, b), n = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))
        new = 256 + r
        merges.append((r, a, b, new, n))
        nw = {}
        for ids, c in work.items():
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            nw[tuple(out)] = nw.get(tuple(out), 0) + c
        work = nw
    return merges


def _counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return df, TZ.pretoken_counts(TZ.pretokenize(df))


def test_pretokenize_matches_regex_module_and_is_lossless(spark):
    df, _ = _counts(spark)
    got = {r["doc_id"]: list(r["p"]) for r in df.select("doc_id", TZ.pieces_col("text").alias("p")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == regex.findall(TZ.SPLIT_PATTERN, t)
        assert "".join(got[i]) == t


def test_train_bpe_matches_plain_python(spark):
    _, counts = _counts(spark)
    c = {r["piece"]: r["count"] for r in counts.collect()}
    got = [tuple(r) for r in TZ.train_bpe(counts, 256 + 20 + 9, guesses=4).orderBy("rank").collect()]
    assert got == py_train(c, 20)


def test_encode_matches_tiktoken_with_our_ranks(spark):
    df, counts = _counts(spark)
    vocab = TZ.build_vocab(TZ.train_bpe(counts, 256 + 30 + 9))
    ranks = {bytes(r["token"]): r["token_id"] for r in vocab.collect() if not r["is_special"]}
    enc = tiktoken.Encoding("t", pat_str=TZ.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: list(r["ids"]) for r in TZ.encode_corpus(df, vocab).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == enc.encode_ordinary(t)
    back = {r["doc_id"]: r["text"] for r in TZ.decode_tokens(TZ.encode_corpus(df, vocab), "ids", vocab).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS


def _pieces_of(shard):
    """Tokens of each piece, in order."""
    out, i = [], 0
    firsts = [i for i in range(len(shard.tok)) if shard.tok[i] >= 0 and shard.prv[i] < 0]
    for i in firsts:
        own = []
        while i >= 0:
            own.append(int(shard.tok[i]))
            i = int(shard.nxt[i])
        out.append(own)
    return out


def test_overlapping_pair_merged_once_left_to_right():
    s = BPE.PieceShard([b"aaa", b"abab", b"aaaaa", b"baab"], [1, 1, 1, 1])
    s.merge(97, 97, 300)
    assert _pieces_of(s) == [[300, 97], [97, 98, 97, 98], [300, 300, 97], [98, 300, 98]]
    s.merge(97, 98, 301)
    assert _pieces_of(s)[1] == [301, 301]


def _pair_counts(pieces, weights):
    pc = collections.Counter()
    for ids, c in zip(pieces, weights):
        for a, b in zip(ids, ids[1:]):
            pc[a * BPE.TOKENS + b] += c
    return pc


def test_changes_of_a_merge_are_those_of_counting_again():
    rnd = random.Random(7)
    pieces = [bytes(rnd.choice(b"aab") for _ in range(rnd.randrange(1, 14))) for _ in range(60)]
    weights = [rnd.randrange(1, 5) for _ in pieces]
    s, work = BPE.PieceShard(pieces, weights), [list(p) for p in pieces]
    for new, (a, b) in enumerate([(97, 97), (97, 98), (256, 256), (256, 257), (257, 257), (98, 97)], 256):
        before = _pair_counts(work, weights)
        pairs, change = BPE.PieceShard.load(s.dump()).merge(a, b, new)
        assert [x.tolist() for x in s.merge(a, b, new)] == [pairs.tolist(), change.tolist()]
        work = _pieces_of(s)
        after = _pair_counts(work, weights)
        after.subtract(before)
        assert dict(zip(pairs.tolist(), change.tolist())) == {k: v for k, v in after.items() if v}


@pytest.mark.parametrize("guesses, candidates", [(1, 4096), (7, 3), (32, 4096)])
def test_rounds_and_guesses_do_not_change_the_merges(spark, monkeypatch, guesses, candidates):
    monkeypatch.setattr(TZ, "CANDIDATES", candidates)
    monkeypatch.setattr(TZ, "SAMPLE_PIECES", 9)
    monkeypatch.setattr(TZ, "SHARD_BYTES", 40)
    rnd = random.Random(2)
    counts = {"".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 9))): rnd.randrange(1, 50) for _ in range(80)}
    df = spark.createDataFrame(list(counts.items()), "piece string, count long")
    got = [tuple(r) for r in TZ.train_bpe(df, 256 + 25 + 9, guesses=guesses).orderBy("rank").collect()]
    assert got == py_train(counts, 25)


def test_a_long_piece_takes_no_quadratic_time():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"aa": 259}
    start = time.process_time()
    ids = BPE.encode_piece(b"ab" * 50_000, ranks)
    assert ids == [257] * 25_000 and BPE.encode_piece(b"a" * 100_001, ranks) == [259] * 50_000 + [97]
    assert time.process_time() - start < 2


def test_no_pieces_no_merges(spark):
    assert TZ.train_bpe(spark.createDataFrame([], "piece string, count long"), 300).count() == 0


@pytest.mark.parametrize("replayed", [1, 6, 512])
def test_rounds_write_no_state_until_merges_done_again_cost_more(spark, monkeypatch, tmp_path, replayed):
    monkeypatch.setattr("tessera.session.scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(TZ, "REPLAYED", replayed)
    rnd = random.Random(3)
    counts = {"".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 9))): rnd.randrange(1, 50) for _ in range(80)}
    df = spark.createDataFrame(list(counts.items()), "piece string, count long")
    got = [tuple(r) for r in TZ.train_bpe(df, 256 + 20 + 9, guesses=4).orderBy("rank").collect()]
    assert got == py_train(counts, 20)
    stored = [p.parent.name for p in tmp_path.glob("bpe-*/*/is_state=true")]
    assert stored == ["0"] if replayed == 512 else len(stored) > 1


def test_a_shard_before_its_merges_is_stored_as_its_pieces():
    rnd = random.Random(4)
    pieces = [bytes(rnd.randrange(97, 123) for _ in range(10)) for _ in range(5000)]
    s = BPE.PieceShard(pieces, [1] * 5000)
    assert len(s.dump()) < 4 * 50_000
    s.merge(97, 98, 256)
    again = BPE.PieceShard.load(s.dump())
    assert [a.tolist() for a in again.merge(98, 99, 257)] == [a.tolist() for a in s.merge(98, 99, 257)]
