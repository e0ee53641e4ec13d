"""Structured Streaming: corpus shards and step records as they arrive.

The reference's only stream is a resumable generator over shards in the order
of their names; here the position is the streaming checkpoint (exact, not
approximate). ``NamedShards`` is a streaming source whose offset is the name of
the last shard read, so the order is that of names whatever the files' times,
and ``Trigger.AvailableNow`` drains what exists and stops.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.codec import ByteCodec


class _Shard(InputPartition):
    def __init__(self, root: str, name: str):
        self.root, self.name = root, name


class _ShardReader(DataSourceStreamReader):
    """Offsets are shard names. A micro-batch has a partition for each shard named
    after the last one read, so memory is that of one row group per task."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _system(self):
        from pyarrow import fs
        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if not self.path.startswith("file://") and self.path.startswith("file:") else self.path)

    def names(self) -> list[str]:
        from pyarrow import fs
        system, root = self._system()
        found = [f.path[len(root.rstrip("/")) + 1:] for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
                 if f.is_file and f.path.endswith(".parquet")]
        return sorted(n for n in found if not any(x[0] in "._" for x in n.split("/")))

    def initialOffset(self) -> dict:
        return {"shard": ""}

    def latestOffset(self) -> dict:
        return {"shard": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Shard(self.path, n) for n in self.names() if start["shard"] < n <= end["shard"]]

    def read(self, partition) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        system, root = self._system()
        with system.open_input_file(f"{root}/{partition.name}") as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1024, columns=self.columns):
                yield pa.RecordBatch.from_arrays([*b.select(self.columns).columns, pa.array([partition.name] * b.num_rows)], [*self.columns, "shard_file"])


class NamedShards(DataSource):
    """``spark.readStream.format("named_shards").schema(...).load(path)``: Parquet
    shards under a folder (a local path or a URI that pyarrow opens), in the order
    of their names. A shard counts once it has its final name; one that appears
    under a name before the last one read is not picked up."""

    @classmethod
    def name(cls) -> str:
        return "named_shards"

    def schema(self) -> str:
        return "doc_id long, text string, shard_file string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ShardReader(self.options["path"], [f.name for f in schema if f.name != "shard_file"])


def stream_corpus(spark: SparkSession, src: str, out: str, checkpoint: str, schema: str = "doc_id long, text string",
                  codec: ByteCodec | None = None, available_now: bool = True) -> StreamingQuery:
    """Tokenize new shards, in the order of their names, into a Parquet sink.

    The checkpoint records the last shard done, so a restart resumes exactly
    behind it; tasks of a batch take one shard each.
    """
    codec = codec or ByteCodec()
    spark.dataSource.register(NamedShards)
    s = spark.readStream.format("named_shards").schema(f"{schema}, shard_file string").load(src)
    toks = s.select("doc_id", F.concat(F.array(F.lit(codec.bos)), codec.encode_col(F.col("text"))).alias("ids"), "shard_file")
    w = toks.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out)


#: Groups of runs that share a state: a call of Python for each, not for each run.
RUN_GROUPS = 256
STATE_SCHEMA = "run array<long>, ema array<double>, best array<double>, total array<double>, last_step array<long>"
OUT_SCHEMA = "run_id long, step long, smooth_loss double, min_val_bpb double, total_training_time double"
WAITING = ", run_id array<long>, step array<long>, loss array<double>, val_bpb array<double>, dt array<double>"
_RECORD = ["run_id", "step", "loss", "val_bpb", "dt"]


def _kept(columns) -> dict[int, tuple]:
    """The four numbers of each run of a state."""
    run, *numbers = map(list, columns)
    return dict(zip(run, zip(*numbers)))


def _columns(kept: dict[int, tuple]) -> tuple[list, ...]:
    return ([*kept], *([v[i] for v in kept.values()] for i in range(4)))


def _advance(kept: dict[int, tuple], records: pd.DataFrame, beta: float) -> pd.DataFrame | None:
    """Take ``records`` into the numbers of their runs, each run's in step order."""
    if records["run_id"].isna().any():
        raise ValueError("a step record without run_id")
    df, out = records.sort_values(["run_id", "step"], kind="stable"), []
    for run, part in df.groupby("run_id", sort=False).indices.items():
        run = int(run)
        ema, best, total, last = kept.get(run, (0.0, math.inf, 0.0, -1))
        rows = (df[c].to_numpy()[part].tolist() for c in _RECORD[1:])
        for step, loss, bpb, dt in zip(*rows):
            best = min(best, bpb)
            if step > 10:
                total += dt
            if step <= last:  # late: counts for the minimum and the time, but the average has gone on
                out.append((run, int(step), None, best, total))
                continue
            ema = beta * ema + (1 - beta) * loss
            out.append((run, int(step), ema / (1 - beta ** (step + 1)), best, total))
            last = step
        kept[run] = ema, best, total, int(last)
    return pd.DataFrame(out, columns=["run_id", "step", "smooth_loss", "min_val_bpb", "total_training_time"]) if out else None


def _run_metrics_fn(beta: float):
    """For a group of runs, or for the run that the key names if records have no run_id."""
    def fn(key, pdfs, state):
        kept = _kept(state.get) if state.exists else {}
        frames = [(p if "run_id" in p else p.assign(run_id=int(key[0])))[_RECORD] for p in pdfs if len(p)]
        if not frames:
            return
        out = _advance(kept, pd.concat(frames), beta)
        state.update(_columns(kept))
        if out is not None:
            yield out
    return fn


def _ordered_metrics_fn(beta: float):
    """As ``_run_metrics_fn``, but records wait in the state until the watermark
    has passed their step; a timer wakes the runs for those that are left."""
    def fn(key, pdfs, state):
        got = tuple(map(list, state.get)) if state.exists else ([],) * 10
        kept, waiting = _kept(got[:5]), pd.DataFrame(dict(zip(_RECORD, got[5:]))).astype({"run_id": "int64", "step": "int64"})
        if not state.hasTimedOut:
            frames = [p[_RECORD] for p in pdfs if len(p)]
            waiting = pd.concat([x for x in (waiting, *frames) if len(x)]) if frames else waiting
        passed = state.getCurrentWatermarkMs()
        ready = (waiting["step"] + 1) * 1000 <= passed
        rest = waiting[~ready]
        if ready.any():
            out = _advance(kept, waiting[ready], beta)
            if out is not None:
                yield out
        state.update((*_columns(kept), *(rest[c].tolist() for c in _RECORD)))
        if len(rest):
            state.setTimeoutTimestamp(max((int(rest["step"].min()) + 1) * 1000, passed + 1))
    return fn


def run_metrics_stream(records: DataFrame, beta: float = 0.9, late_steps: int | None = None) -> DataFrame:
    """Per run, in step order: debiased EMA of the loss, best val_bpb so far
    and training time after step 10.

    Without ``late_steps`` records are taken as they come: state per run is four
    numbers, and a record that comes after a later step of its run has a null
    average. Runs are dealt by hash to ``RUN_GROUPS`` groups with one state each,
    so calls of Python don't grow with the runs. With ``late_steps`` a step is an event time (second s for step s)
    under a watermark so many steps behind the latest: records wait in the state
    until it has passed them, so steps that come up to that late enter in order.
    The state is the records of the last ``late_steps`` steps; records later than
    that are not taken. A record of a step far ahead closes all runs.
    """
    records = records.withColumn("run_group", F.pmod(F.xxhash64("run_id"), F.lit(RUN_GROUPS)))
    if late_steps is None:
        return (records.groupBy("run_group")
                       .applyInPandasWithState(_run_metrics_fn(beta), OUT_SCHEMA, STATE_SCHEMA, "append",
                                               GroupStateTimeout.NoTimeout))
    timed = records.withColumn("at", F.timestamp_seconds(F.col("step") + 1)).withWatermark("at", f"{late_steps} seconds")
    return timed.groupBy("run_group").applyInPandasWithState(_ordered_metrics_fn(beta), OUT_SCHEMA, STATE_SCHEMA + WAITING, "append",
                                                          GroupStateTimeout.EventTimeTimeout)


def stream_run_metrics(spark: SparkSession, src: str, out: str, checkpoint: str,
                       schema: str = "run_id long, step long, loss double, val_bpb double, dt double",
                       files_per_trigger: int = 1, beta: float = 0.9, late_steps: int | None = None) -> StreamingQuery:
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    q = (run_metrics_stream(s, beta, late_steps).writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True))
    return q.start(out)
