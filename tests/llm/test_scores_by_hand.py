"""The rows of the classifiers' queries against a plain restatement: whole tables,
features by their rules in Python numbers, the fitted model's weights."""

import math
import re
import zlib

import pytest
import xxhash
from tessera.llm import nbsvm, queries, toxicity

SF = "/root/testdata/sf0.001"
ALL = 1 << 64


def share(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def fields(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def shape(word):
    out = ""
    for run in re.findall(r"[^\W\d_]+|\d+|[\W_]", word):
        out += ("A" if run.isupper() and len(run) > 1 else "a") if run[0].isalpha() else "0" if run[0].isdigit() else run
    return re.sub(r"(.)\1+", r"\1\1", out)


def shape_grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    again = xxhash.xxh32_intdigest(b"again")
    one = [again if k and w == words[k - 1] else xxhash.xxh32_intdigest(shape(w).encode()) for k, w in enumerate(words)]
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77 + 1) % ALL for a, b in zip(one, one[1:])]
    three = [(a * 0xC2B2AE3D + b * 0x27D4EB2F + 2) % ALL for a, b in zip(two, one[2:])]
    return {((g ^ g >> 29) * 0xBF58476D1CE4E5B9 % ALL >> 40) % nbsvm.DIM for g in {*one, *two, *three}}


def test_quality_rows(spark):
    model = nbsvm.fit(fields(spark, "documents"), fields(spark, "labels"))
    got = {r.doc_id: r for r in queries.op6_quality(spark, SF).collect()}
    all_texts = texts(spark)
    assert set(got) == set(all_texts)
    for i, t in all_texts.items():
        grams = shape_grams(t)
        length = max(1e-9, math.sqrt(sum(model.ratio[g] ** 2 for g in grams)))
        score = share(model.slope * (sum(model.weight[g] for g in grams) / length + model.bias) + model.shift)
        assert got[i].score == pytest.approx(score, abs=1e-6), i
        assert got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.7)


def toxic_features(text):
    out = set()
    for w in text.lower().split():
        w = w.strip(".,;:!?\"'()[]{}*#%&$|<>")
        if w:
            runs = {f"^{w}$"[a : a + n] for n in (4, 5) for a in range(len(w) + 3 - n)}
            out |= {zlib.crc32(w.encode()) % toxicity.DIM} | {zlib.crc32(r.encode(), 1) % toxicity.DIM for r in runs}
    return out


def test_toxicity_rows(spark):
    model = toxicity.fit(fields(spark, "documents"), fields(spark, "labels"))
    weight = dict(zip(model.ids.tolist(), model.weight.tolist()))
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, SF).collect()}
    all_texts = texts(spark)
    assert set(got) == set(all_texts)
    for i, t in all_texts.items():
        score = share(sum(weight.get(f, 0.0) for f in toxic_features(t)) + model.bias)
        assert got[i].score == pytest.approx(score, abs=1e-6), i
        assert got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.3)
