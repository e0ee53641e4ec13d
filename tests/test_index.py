import random

from pyspark.sql import functions as F

from tessera.functions.index import prefix_sum
from tessera.operators import selection as S


def test_prefix_sum_matches_cumsum_and_partitioning(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 9), i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, g long")
    for d in (df.coalesce(1), df.repartition(7)):
        got = {(r["g"], r["k"]): (r["idx"], r["before"]) for r in prefix_sum(d, "k", "v", by=["g"], buckets=5).collect()}
        for g in range(3):
            acc, i = 0, 0
            for k, v, gg in rows:
                if gg != g:
                    continue
                assert got[(g, k)] == (i, acc)
                acc += v
                i += 1


def test_char_budget_keeps_crossing_doc(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(10)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in S.char_budget(df, 25).collect())
    assert kept == [0, 1, 2]


def test_split_fractions_disjoint_and_complete(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    s = S.split_fractions(df, 0.8, 0.1, "k")
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 82, "val": 10, "test": 11}
    assert s.select("k").distinct().count() == 103


def test_slice_rows_length(spark):
    df = spark.range(20).withColumnRenamed("id", "i")
    assert S.slice_rows(df, "i", 5, 10, 2).count() == 3
