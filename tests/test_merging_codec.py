import json
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tessera.functions.codec import ids_text
from tessera.operators import captions as CP
from tessera.operators import evaluate as EV
from tessera.operators import runs as RN
from tessera.operators import tokenize as TZ

RANKS = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate([b"th", b"the", b" the", b"  ", b"\n\n", b"12", b"ab", b"!!", b" a", b"'s", b" 1", b"abab", b"\n ", b"the ab"])}


def whole(text):
    cache = TZ.PieceCache(RANKS)
    return np.frombuffer(b"".join(map(cache.__getitem__, regex.findall(TZ.SPLIT_PATTERN, text))), "<i4").tolist()


def test_seams_equal_whole_prompts():
    rnd, find, cache = random.Random(5), regex.compile(TZ.SPLIT_PATTERN).finditer, TZ.PieceCache(RANKS)
    signs = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\t", "1", "23", "!", "!!", "'", "s", "'ll", "é", "\r", "日", "　", "."]
    text = lambda n: "".join(rnd.choice(signs) for _ in range(rnd.randrange(n)))
    for _ in range(4000):
        before, after, options = text(9), text(9), [text(6) for _ in range(3)]
        for o, (ids, head, tail) in zip(options, TZ.seam_ids(find, cache.__getitem__, before, options, after)):
            assert ids.tolist() == whole(before + o + after), (before, o, after)
            assert head + tail <= len(ids)


def test_only_pieces_at_the_bounds_are_encoded_again():
    find, seen = regex.compile(TZ.SPLIT_PATTERN).finditer, []
    cache = TZ.PieceCache(RANKS)

    def encode(piece):
        seen.append(piece)
        return cache[piece]
    before, after = "the ab " * 500, " the ab" * 500
    TZ.seam_ids(find, encode, before, ["x", "y", "the"], after)
    assert len(seen) < 2010 + 3 * 4


def spans_by_hand(before, options, after, kind, bos):
    ids = [[bos, *whole(before + o + after)] for o in options]
    if kind == "schema":
        ids = [x[::-1] for x in ids]
    n = 0
    while all(len(x) > n for x in ids) and len({x[n] for x in ids}) == 1:
        n += 1
    return [(len(x) - n if kind == "schema" else n, len(x)) for x in ids]


def test_spans_under_a_trained_vocabulary(spark):
    vocab = spark.createDataFrame([(i, t, False) for t, i in RANKS.items()] + [(len(RANKS), b"<|bos|>", True)], "token_id int, token binary, is_special boolean")
    codec = TZ.BpeCodec(vocab)
    rows = [(0, "Which? the ", ["ab", "abab", "th"], ""), (1, "", ["the ab", "a the ab"], " the end"), (2, "x", ["", "1"], "23"), (3, "", [], "y")]
    parts = spark.createDataFrame(rows, "idx long, before string, options array<string>, after string")
    for kind in ("mc", "schema"):
        got = {(r.idx, r.opt): (list(r.ids), r.start, r.end) for r in EV.option_spans_items(parts, kind, codec).collect()}
        for i, before, options, after in rows:
            for k, (start, end) in enumerate(spans_by_hand(before, options, after, kind, codec.bos)):
                assert got[i, k] == ([codec.bos, *whole(before + options[k] + after)], start, end)
        assert len(got) == 7


def test_unknown_ids_show(spark):
    vocab = spark.createDataFrame([(104, b"h", False), (105, b"i", False), (7, b"<|x|>", True)], "token_id int, token binary, is_special boolean")
    df = spark.createDataFrame([([104, 9999, 105],), ([7, 104, -1],), ([50, 105],), ([],), (None,)], "ids array<int>")
    assert [r.text for r in TZ.decode_tokens(df, "ids", vocab).collect()] == ["h�i", "h�", "�i", "", None]


def test_words_are_looked_up_alike_beyond_the_bound(spark, monkeypatch):
    vocab = spark.createDataFrame([("the", 3), ("cat", 4)], "word string, id int")
    df = spark.createDataFrame([(1, "The  CAT the dog"), (2, ""), (3, None)], "k long, t string")
    want = {1: [1, 3, 4, 3, 0, 2], 2: [1, 2], 3: [1, 2]}
    for bound in (100, 1):
        monkeypatch.setattr(TZ, "WORDS_SENT", bound)
        assert {r.k: list(r.ids) for r in TZ.word_encode(df, "t", vocab, "k").collect()} == want


def test_other_keys_and_types_of_a_line_stay(spark):
    lines = ['{"image_id": 5, "split": "x", "w": 1.5, "n": null, "messages": [{"role": "user", "content": "q", "lang": "en"}, {"role": "assistant", "score": 2, "content": "old"}], "z": [1, {"a": true}]}',
             '{"image_id": "5", "id": 12345678901234567}', "no json", '{"split": "y"}', '{"image_id": 9, "messages": []}', '[{"role": "user", "content": "hi"}]']
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    anns = spark.createDataFrame([(1, 5, "one"), (2, 5, 'two "quoted"')], "ann_id long, image_id long, caption string")
    got = {(r.line_no, r.caption_idx): r.line for r in CP.expand_existing(df, anns).collect()}
    assert len(got) == 8
    for k, cap in ((0, "one"), (1, 'two "quoted"')):
        want = json.loads(lines[0])
        want["messages"][1]["content"] = cap
        assert json.loads(got[0, k]) == want and list(json.loads(got[0, k])) == list(want) and '"image_id":5' in got[0, k]
        made = json.loads(got[1, k])
        assert made["image_id"] == "5" and made["id"] == 12345678901234567 and made["messages"][1] == {"role": "assistant", "content": cap}
    assert all(got[i, None] == lines[i] for i in (2, 3, 4, 5))


def test_moments_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400)
    fits = []
    for offset in (0.0, 1e9):
        df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x + offset, y + offset)], "a double, b double, y double").repartition(7)
        fits.append(RN.ridge_fit(df, ["a", "b"], "y", [0.5]).first())
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 0.5 * np.eye(2), xc.T @ yc)
    assert list(fits[0].weights) == pytest.approx(list(w), rel=1e-9)
    # at 1e9 a double has steps of 1e-7 itself
    assert list(fits[1].weights) == pytest.approx(list(w), rel=1e-6) and fits[1].r2 == pytest.approx(fits[0].r2, rel=1e-6)


def test_problems_without_completions_count(spark):
    items = spark.createDataFrame([(i, [("user", "q", None), ("assistant", f"#### {i}", None)]) for i in range(3)],
                                  "problem long, messages array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>")
    done = spark.createDataFrame([(0, 0, "#### 0"), (1, 0, "none"), (1, 1, "#### 1")], "problem long, sample int, completion string")
    m = EV.answer_match(items, done)
    assert EV.generative_eval(m).first()["n_problems"] == 3 and EV.generative_eval(m).first()["n_passed"] == 2
    assert {r.problem: r.correct for r in m.filter("sample is null").collect()} == {2: 0}


MADE = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate([b"th", b"he", b" t", b"in", b"ab", b"abab", b"the", b"ing", b"  ", b"..", b".\n"])}


def test_texts_encoded_together_equal_their_pieces_one_by_one():
    rnd, enc, cache = random.Random(7), TZ.TextEncoder(MADE), TZ.PieceCache(MADE)
    assert enc.merger.table is not None and TZ.TextEncoder(RANKS).merger.table is None  # "the ab" can't be merged from " the" and "ab"
    plain = ["a", "the", " ", " ", "\n", ".", "..", "x.y", "abab", "(", "ing"]
    odd = ["  ", "\n\n", "\t", "1", "23", "'", "s", "'ll", "é", "\r", "日", "　", "\x1c", "\u0085", "a" * 40]
    for signs in (plain, plain + odd):
        for _ in range(600):
            texts = [None if rnd.random() < 0.05 else "".join(rnd.choice(signs) for _ in range(rnd.randrange(14))) for _ in range(4)]
            want = [None if t is None else b"".join(map(cache.__getitem__, regex.findall(TZ.SPLIT_PATTERN, t))) for t in texts]
            assert enc.encode(texts) == want, texts
    long = ["ab" * 50_000, "the. " * 30_000, "", None]
    assert enc.encode(long) == [None if t is None else b"".join(map(cache.__getitem__, regex.findall(TZ.SPLIT_PATTERN, t))) for t in long]


def test_plain_words_are_not_searched():
    enc, seen = TZ.TextEncoder(MADE), []
    find = enc.find
    enc.find = lambda t: seen.append(t) or find(t)
    enc.encode(["The abab, in the thing.\nThen (some) more.", "a 12 b"])
    assert seen == [" 12"]


def test_ids_as_text_equal_joined_arrays(spark):
    rows = [(0, [1, 256, 70_000]), (1, []), (2, None), (3, [0]), (4, [5, None, 7]), (5, [-1, 3]), (6, [1 << 24])]
    df = spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1)
    got = df.select("k", ids_text("ids").alias("a"), F.array_join("ids", ",").alias("b")).collect()
    assert len(got) == 7 and all(r.a == r.b for r in got)
