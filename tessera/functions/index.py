"""Global row index and prefix sums without a single-task window.

A ``Window.orderBy`` without ``partitionBy`` moves every row into one task.
Instead the keys are range-partitioned and sorted by Spark (``ranged``) and
written once, each row with its partition and its place there; per-partition
totals (one row per partition and group) give the offsets. The written table
holds keys and numbers only, so wide columns such as texts are neither sorted
nor carried along: they are joined back to their positions by key. A group
that has most rows is cut into ranges like the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FractionalType, MapType, StringType, StructType, VariantType

from ..session import scratch_path

_WIDE = (StringType, BinaryType, ArrayType, MapType, StructType, VariantType)


def ranged(df: DataFrame, keys: Sequence[str], parts: int | None = None, add=None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, written once: adds
    ``__p`` (partition) and ``__at`` (ascending within a partition). ``add``:
    a function on the sorted rows, such as a scan in order, run before writing.

    Later reads see the same ranges, whatever tasks are lost. ``parts``: number
    of ranges; by default Spark's shuffle partitions, merged where small."""
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys)
    if add is not None:
        dealt = add(dealt)
    dealt = dealt.withColumn("__p", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    path = scratch_path(df.sparkSession, f"ranged-{uuid.uuid4().hex[:10]}")
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of columns, pair by pair: a null group is a group."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def offsets(held: DataFrame, by: Sequence[str], **sums: Column) -> DataFrame:
    """Per partition and group of ``ranged`` rows: group columns as ``__by0`` …,
    ``__ob``, the group's rows in the partitions before (``__on``), the lowest
    ``__at`` (``__low``), and each of ``sums`` added up over those before."""
    tot = held.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__tn"), F.min("__at").alias("__low"),
                                       *[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return tot.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__p").alias("__ob"), "__low",
                      F.coalesce(F.sum("__tn").over(w), F.lit(0)).alias("__on"),
                      *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])


def with_offsets(held: DataFrame, off: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [f"__by{i}" for i in range(len(by))]
    return held.join(off, same_keys([*by, "__p"], [*names, "__ob"])).drop("__ob", *names)


def prefix_sum(df: DataFrame, order: str | Sequence[str], value: str | Column | None = None,
               by: Sequence[str] = (), idx: str = "idx", before: str = "before",
               buckets: int | None = None, small_groups: bool = False) -> DataFrame:
    """Add ``idx`` (0-based rank in ``order`` within ``by``) and ``before``
    (sum of ``value`` over the earlier rows of the same group).

    ``order`` must be unique within a group. ``buckets``: ranges to cut the
    keys into (see ``ranged``). ``small_groups=True`` means every group is
    small enough for one task (e.g. one conversation), so a plain partitioned
    window is used.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = list(by)
    val = F.lit(1) if value is None else (F.col(value) if isinstance(value, str) else value)
    df = df.withColumn("__v", val)
    vtype = "double" if isinstance(df.schema["__v"].dataType, FractionalType) else "bigint"

    if small_groups:
        w = Window.partitionBy(*by).orderBy(*order)
        out = (df.withColumn(idx, F.row_number().over(w) - 1)
                 .withColumn(before, F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, -1))))
        out = out.withColumn(before, F.coalesce(F.col(before), F.lit(0)).cast(vtype))
        return out.drop("__v")

    keys = list(dict.fromkeys([*by, *order]))
    wide = any(isinstance(f.dataType, _WIDE) for f in df.schema if f.name not in keys)
    held = ranged(df.select(*keys, "__v") if wide else df, keys, buckets)
    if value is None:
        local, off = held, offsets(held, by)
        out = with_offsets(local, off, by).withColumn(idx, (F.col("__on") + F.col("__at") - F.col("__low")).cast("bigint"))
        out = out.withColumn(before, F.col(idx).cast(vtype))
    else:
        inside = Window.partitionBy(*by, "__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        local = held.withColumn("__lb", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        off = offsets(held, by, __ov=F.col("__v"))
        out = (with_offsets(local, off, by)
               .withColumn(idx, (F.col("__on") + F.col("__at") - F.col("__low")).cast("bigint"))
               .withColumn(before, (F.col("__ov") + F.col("__lb")).cast(vtype)).drop("__lb", "__ov"))
    out = out.drop("__v", "__p", "__at", "__on", "__low")
    if not wide:
        return out
    places = out.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], idx, before)
    names = [f"__k{i}" for i in range(len(keys))]
    return df.drop("__v", idx, before).join(places, same_keys(keys, names)).drop(*names)


def global_index(df: DataFrame, order: str | Sequence[str], by: Sequence[str] = (),
                 idx: str = "idx", **kw) -> DataFrame:
    return prefix_sum(df, order, None, by=by, idx=idx, before="__gi_before", **kw).drop("__gi_before")
