import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.streaming import corpus as STR


def put(folder, name, ids, age):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [f"text {i}" for i in ids]}), f"{folder}/{name}", row_group_size=2)
    os.utime(f"{folder}/{name}", (1_700_000_000 - age, 1_700_000_000 - age))


def test_shards_come_in_the_order_of_names_and_a_restart_goes_on(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    put(src, "shard=2/b.parquet", [20, 21, 22], 50)
    put(src, "shard=1/a.parquet", [10, 11], 0)  # the newest file has the first name
    put(src, "shard=3/.c.parquet", [99], 0)
    assert STR._ShardReader(src, []).names() == ["shard=1/a.parquet", "shard=2/b.parquet"]
    STR.stream_corpus(spark, src, out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert [r.doc_id for r in got.orderBy("shard_file", "doc_id").collect()] == [10, 11, 20, 21, 22]
    assert got.filter("doc_id = 20").first()["ids"][0] == 261
    put(src, "shard=3/c.parquet", [30], 100)
    put(src, "shard=0/late.parquet", [5], 0)  # named before what was read: not picked up
    STR.stream_corpus(spark, src, out, ck).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [10, 11, 20, 21, 22, 30]


def test_late_steps_enter_the_average_in_order(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    files = [[(1, 0), (1, 3), (2, 1)], [(1, 2), (1, 1), (1, 5)], [(1, 4), (1, 6), (2, 9)], [(-1, 10_000)]]
    for part in files:
        spark.createDataFrame([(r, s, float(s), 1.0 + s, 0.5) for r, s in part], "run_id long, step long, loss double, val_bpb double, dt double").coalesce(1).write.mode("append").parquet(src)
    STR.stream_run_metrics(spark, src, out, ck, late_steps=4).awaitTermination()
    got = {(r.run_id, r.step): r.smooth_loss for r in spark.read.parquet(out).filter(F.col("run_id") > 0).collect()}
    want = {}
    for run, steps in ((1, range(7)), (2, (1, 9))):
        ema = 0.0
        for s in steps:
            ema = 0.9 * ema + 0.1 * s
            want[run, s] = ema / (1 - 0.9 ** (s + 1))
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
