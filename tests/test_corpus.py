import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as EV
from tessera.operators import runs as RN
from tessera.sources import corpus as C


def fold_shards(chars, target):
    """The close rule as a fold over blocks."""
    out, shard, acc, first, pending = [], 0, 0, None, []
    for b, c in enumerate(chars):
        first = b if first is None else first
        acc += c
        pending.append((b, shard, first))
        if acc >= target:
            out += [(*x, False) for x in pending]
            pending, shard, acc, first = [], shard + 1, 0, None
    return out + [(*x, True) for x in pending]


@pytest.mark.parametrize("n, target, chunk", [(1, 5, 4), (37, 10, 4), (50, 7, 8), (60, 1000, 8), (40, 0, 8), (64, 33, 16), (30, 30, 100)])
def test_shards_close_as_the_fold_does(spark, n, target, chunk):
    rnd = random.Random(n)
    chars = [rnd.choice([0, 0, 1, 3, 9, rnd.randrange(60)]) for _ in range(n)]
    got = C._close_shards(spark.createDataFrame(list(enumerate(chars)), "block long, bchars long"), target, chunk)
    assert sorted(map(tuple, got.collect())) == fold_shards(chars, target)


def test_shards_written_and_scanned_are_the_same(spark, tmp_path):
    n = 30 * 33
    docs = spark.range(n).select(F.col("id"), (F.col("id") % 30).alias("new_shard"), F.floor(F.col("id") / 30 / 8).alias("new_rg"),
                                 (F.floor(F.col("id") / 30) % 8).cast("int").alias("pos_in_rg"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    C.write_shards(docs.repartition(5), f"{tmp_path}/a b", row_group_rows=8)
    files = sorted((tmp_path / "a b").rglob("*.parquet"))
    assert len(files) == 30 and [pq.read_metadata(f).num_row_groups for f in files] == [5] * 30
    scan = C.scan_corpus(spark, f"{tmp_path}/a b")
    got = {(r.shard_id, r.rg_id, r.pos_in_rg): (r.text, r.doc_id) for r in scan.collect()}
    want = {(r.new_shard, r.new_rg, r.pos_in_rg): r.text for r in docs.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert len({v[1] for v in got.values()}) == n
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_row_groups_of_uneven_files(spark, tmp_path):
    spark.range(0, 25, 1, 1).selectExpr("cast(id as string) text").write.option("parquet.block.row.count.limit", "10").parquet(f"{tmp_path}/x/one")
    spark.range(100, 104, 1, 1).selectExpr("cast(id as string) text").write.parquet(f"{tmp_path}/x/two")
    got = sorted((r.shard_id, r.rg_id, r.pos_in_rg, r.text) for r in C.scan_corpus(spark, f"{tmp_path}/x").collect())
    assert got == [(0, i // 10, i % 10, str(i)) for i in range(25)] + [(1, 0, i, str(100 + i)) for i in range(4)]


def test_average_of_sparse_steps_follows_records(spark):
    rows = [(1, 0, 1.0), (1, 10, 2.0), (2, 5, 3.0), (None, 1, 4.0)]
    got = {(r.run_id, r.step): r.smooth_loss for r in RN.smoothed_loss(spark.createDataFrame(rows, "run_id long, step long, loss double")).collect()}
    assert got[(1, 10)] == pytest.approx((0.9 * 0.1 + 0.2) / (1 - 0.9 ** 11))
    assert got[(2, 5)] == pytest.approx(0.3 / (1 - 0.9 ** 6)) and got[(None, 1)] == pytest.approx(0.4 / (1 - 0.9 ** 2))


def test_split_bpb_cuts_inside_the_crossing_document(spark):
    rnd = random.Random(1)
    rows = [(s, d, p, rnd.randrange(5), rnd.random()) for s in ("a", "b") for d in range(6) for p in range(rnd.randrange(1, 9))]
    rows += [("c", 0, 0, 1, 0.5)]
    losses = spark.createDataFrame(rows, "split string, doc_id long, pos long, target long, loss double")
    lengths = spark.createDataFrame([(i, i) for i in range(5)], "token_id long, n_bytes int")
    for budget in (1, 7, 12, 1000):
        got = {r.split: (r.total_bytes, r.total_nats) for r in EV.split_bpb(losses, lengths, budget, 1, ["doc_id", "pos"]).collect()}
        for s in "abc":
            own = sorted(x for x in rows if x[0] == s)[:budget]
            assert got[s] == (sum(x[3] for x in own), pytest.approx(round(sum(x[4] for x in own if x[3]), 2)))
