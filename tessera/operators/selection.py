"""Corpus selection, sampling and mixing.

Random draws are replaced by the seeded hash ``h(seed, key)``: the contract is
determinism and distribution, not a particular permutation. Positions come
from the distributed prefix sum, never from a single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h
from ..functions.index import global_index, prefix_sum


def crop_docs(docs: DataFrame, doc_cap: int = 10_000, text: str = "text") -> DataFrame:
    """First ``doc_cap`` characters (code points) of each document."""
    return docs.withColumn(text, F.substring(F.col(text), 1, doc_cap))


def char_budget(docs: DataFrame, max_chars: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Docs in ``order`` until the running character total passes
    ``max_chars``; the crossing doc is kept (keep iff chars before ≤ budget)."""
    d = docs.withColumn("_n", F.length(F.col(text)).cast("bigint"))
    d = prefix_sum(d, order, "_n", idx="_i", before="chars_before")
    return d.filter(F.col("chars_before") <= F.lit(max_chars)).drop("_n", "_i")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, out: str = "shuffle_idx") -> DataFrame:
    """Deterministic permutation: position = rank of ``(h(seed,key), key)``."""
    d = df.withColumn("_h", h(seed, key))
    return global_index(d, ["_h", key], idx=out).drop("_h")


def take_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """First ``n`` rows of the seeded shuffle (a distributed top-n)."""
    return df.withColumn("_h", h(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def split_fractions(df: DataFrame, train: float, val: float, key: str, seed: int = 42) -> DataFrame:
    """Shuffle; the first ``int(n*train)`` rows are train, the next
    ``int(n*val)`` val, the rest test."""
    n = df.count()
    n_train, n_val = int(n * train), int(n * val)
    d = seeded_shuffle(df, key, seed, out="_i")
    split = (F.when(F.col("_i") < n_train, "train")
              .when(F.col("_i") < n_train + n_val, "val").otherwise("test"))
    return d.withColumn("split", split).drop("_i")


def slice_rows(df: DataFrame, idx: str, start: int = 0, stop: int | None = None, step: int = 1,
               out: str = "slice_idx") -> DataFrame:
    """Every ``step``-th row of a numbered table from ``start`` on, below
    ``stop`` if given, renumbered in ``out``. Bounds past the table's end give
    fewer rows, never an error; null numbers are in no slice."""
    if step < 1 or start < 0 or (stop is not None and stop < start):
        raise ValueError(f"no slice: start={start}, stop={stop}, step={step}")
    offset = F.col(idx) - start
    wanted = (offset >= 0) & (offset % step == 0)
    return df.filter(wanted if stop is None else wanted & (offset < stop - start)).withColumn(
        out, F.floor(offset / step).cast("bigint"))


def mix_tasks(tasks: Sequence[tuple[DataFrame, int]], seed: int = 42, idx: str = "idx") -> DataFrame:
    """Union of tasks (task i listed ``copies`` times), one seeded shuffle.

    Each input needs a dense local index ``idx``. Output adds ``task``,
    ``copy`` and ``mix_idx``.
    """
    parts = []
    for t, (df, copies) in enumerate(tasks):
        parts.append(df.withColumn("task", F.lit(t))
                       .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    u = u.withColumn("_h", h(seed, "task", "copy", idx))
    return global_index(u, ["_h", "task", "copy", idx], idx="mix_idx").drop("_h")


def sequence_tasks(tasks: Sequence[DataFrame], idx: str = "idx") -> DataFrame:
    """Tasks one after the other: ``seq_idx`` = rows of earlier tasks + local index."""
    u = None
    for t, df in enumerate(tasks):
        p = df.withColumn("task", F.lit(t))
        u = p if u is None else u.unionByName(p, allowMissingColumns=True)
    tot = u.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))
    off = prefix_sum(tot, "task", "_n", idx="_ti", before="_off", buckets=1).drop("_ti", "_n")
    return (u.join(F.broadcast(off), "task")  # one row per task
             .withColumn("seq_idx", (F.col("_off") + F.col(idx)).cast("bigint")).drop("_off"))


def rank_shards(df: DataFrame, world: int, idx: str = "idx") -> DataFrame:
    """Example i goes to rank ``i % world``."""
    return df.withColumn("rank", F.pmod(F.col(idx), F.lit(world)).cast("int"))
