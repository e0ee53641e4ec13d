import random

from pyspark.sql import functions as F

import reference_impl as R
from tessera.operators import packing as P

C = 65


def _lens(spark, n=400, groups=3, seed=7):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([1, 2, 5, 30, 64, 65, 66, 100, 200, rnd.randint(1, 150)]), i % groups, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, len long, grp long, ord long")


def _by_group(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["grp"], []).append((r["row_id"], r["pos"], r["doc_id"], r["start"], r["len"]))
    return {g: sorted(v) for g, v in out.items()}


def _stream(rows, g):
    return [(d, n) for d, n, gg, _ in sorted(rows, key=lambda x: x[3]) if gg == g]


def test_concat_matches_reference(spark):
    rows, df = _lens(spark)
    got = _by_group(P.pack_concat(df, C - 1))
    for g in range(3):
        assert got.get(g, []) == sorted(R.concat(_stream(rows, g), C))


def test_greedy_crop_matches_reference(spark):
    rows, df = _lens(spark)
    got = _by_group(P.pack_greedy_crop(df, C - 1))
    for g in range(3):
        assert got.get(g, []) == sorted(R.greedy_crop(_stream(rows, g), C))


def test_bestfit_matches_linear_scan_reference(spark):
    rows, df = _lens(spark, n=600)
    got = _by_group(P.pack_bestfit_crop(df.repartition(7), C - 1, buffer=20, refill=4))
    for g in range(3):
        exp = sorted(R.bestfit_crop(_stream(rows, g), C, 20, 4))
        assert got.get(g, []) == exp


def test_bestfit_rows_full_and_start_with_doc(spark):
    rows, df = _lens(spark)
    lay = P.pack_bestfit_crop(df, C - 1, buffer=10, refill=3)
    per_row = lay.groupBy("grp", "row_id").agg(F.sum("len").alias("n"), F.min("pos").alias("p0")).collect()
    assert all(r["n"] == C and r["p0"] == 0 for r in per_row)


def test_ffd_matches_reference(spark):
    rows, df = _lens(spark)
    got = _by_group(P.pack_ffd(df, C - 1))
    for g in range(3):
        items = [(d, n, o) for d, n, gg, o in rows if gg == g]
        assert got.get(g, []) == sorted(R.ffd(items, C))


def test_result_independent_of_partitioning(spark):
    rows, df = _lens(spark)
    a = sorted(map(tuple, P.pack_greedy_pad(df.coalesce(1), C - 1).collect()))
    b = sorted(map(tuple, P.pack_greedy_pad(df.repartition(7), C - 1).collect()))
    assert a == b


def test_report_accounts_for_every_token(spark):
    rows, df = _lens(spark)
    rep = P.packing_report(P.pack_greedy_crop(df, C - 1), df, C - 1, "g").first()
    assert rep["placed_tokens"] + rep["dropped_tokens"] == rep["input_tokens"]
    assert rep["pad_tokens"] == 0
