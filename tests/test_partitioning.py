"""Results must not depend on the number of partitions."""

from given import SF
import __spark_entry__ as E

KEYS = ["pack_concat", "pack_greedy_crop", "pack_bestfit_crop", "seeded_shuffle", "char_budget", "mix_tasks",
        "repackage_shards", "smoothed_loss", "running_min_bpb", "split_bpb", "sample_fewshot", "score_options"]


def _rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_same_result_at_1_and_7_partitions(spark):
    qs = E.queries()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = {}
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out[n] = {k: _rows(qs[k](spark, SF)) for k in KEYS}
        for k in KEYS:
            assert out["1"][k] == out["7"][k], k
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
