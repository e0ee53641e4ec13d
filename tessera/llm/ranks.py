"""Global ranks and running sums without a window over all rows: rows are dealt
into hash buckets, the buckets' totals (a bounded table) give each one's start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets for each of Spark's shuffle partitions, a setting that follows the input.
PER_PARTITION = 4


def running(df: DataFrame, value: Column, order: list[str], name: str, by: list[str] = []) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, within ``by``, in
    an order fixed by the columns ``order`` (their hash, then themselves)."""
    buckets = PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.withColumn("_v", value.cast("long")).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = tagged.groupBy(*by, "_b").agg(F.sum("_v").alias("_t"))
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("_s", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return tagged.withColumn("_p", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(starts, [*by, "_b"]).withColumn(name, F.col("_p") + F.col("_s")).drop("_v", "_b", "_p", "_s")
