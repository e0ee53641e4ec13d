"""Run logs and report sections as tables.

A log is one unit of ordering: it is read whole (a file by ``wholetext``, or
one of many in a file by their separator) and split into numbered lines, because plain line reading carries no reliable
line number. Everything after that is column expressions and grouped
``max_by`` (last matching line wins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Ends a log in a file of many.
LOG_END = "\x1e\n"


def write_run_logs(lines: DataFrame, path: str, run: str = "run_id") -> None:
    """Logs of (run, line_no, line) as text files that hold many logs each: a log
    is its run, its lines in order, and ``LOG_END``. A file for each run costs a
    folder, its listing and an opening each, whatever its size."""
    per = lines.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")))).alias("_l"))
    log = F.array_join(F.concat(F.array(F.coalesce(F.col(run).cast("string"), F.lit(""))), F.transform("_l", lambda x: x["line"])), "\n")
    per.select(log.alias("value")).write.mode("overwrite").option("lineSep", LOG_END).text(path)


def read_run_logs(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """(file, run_id if the folder is partitioned by it, line_no, line). ``many``:
    the files hold many logs each, as ``write_run_logs`` leaves them; run_id is
    the string in a log's first line, null if that is empty."""
    if many:
        logs = spark.read.option("lineSep", LOG_END).text(path)
        raw = logs.select(F.nullif(F.substring_index("value", "\n", 1), F.lit("")).alias("run_id"), "_metadata.file_path",
                          F.when(F.col("value").contains("\n"), F.substr("value", F.instr("value", "\n") + 1)).alias("value"))
        e = raw.select("run_id", F.col("file_path").alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))
        return e.filter(F.col("line") != "")
    raw = spark.read.option("wholetext", True).text(path)
    cols = [c for c in raw.columns if c != "value"]
    e = raw.select(*cols, F.col("_metadata.file_path").alias("file"),
                   F.posexplode(F.split(F.col("value"), "\n", -1)).alias("line_no", "line"))
    return e.filter(F.col("line") != "")


METRIC_RULES = [
    # (metric, how the line is recognised, how the value is read)
    ("depth", "start", "depth: ", r"([\d,]+)"),
    ("params_wte", "start", "wte ", r"([\d,]+)"),
    ("params_lm_head", "start", "lm_head ", r"([\d,]+)"),
    ("params_total", "start", "total ", r"([\d,]+)"),
    ("num_iterations", "contains", "Calculated number of iterations", r": ([\d,]+)\s*$"),
    ("batch_size", "contains", "Total batch size", r"Total batch size ([\d,]+)"),
    ("val_bpb", "contains", "Validation bpb:", r"([\d.]+)$"),
    ("core_score", "contains", "CORE metric:", r"(\S+)\s*$"),
]


def extract_run_metrics(lines: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: the value of the last line matching each rule, commas removed;
    tokens = iterations × batch size; model_dim = depth × 64; a missing CORE
    score is 0.0."""
    line = F.col("line")
    key, val = None, None
    for metric, kind, pat, rx in METRIC_RULES:
        cond = line.startswith(pat) if kind == "start" else line.contains(pat)
        v = F.regexp_replace(F.regexp_extract(line, rx, 1), ",", "")
        key = F.when(cond, F.lit(metric)) if key is None else key.when(cond, F.lit(metric))
        val = F.when(cond, v) if val is None else val.when(cond, v)
    k = lines.select(run, "line_no", key.alias("metric"), val.alias("value")).filter(F.col("metric").isNotNull())
    last = k.groupBy(run, "metric").agg(F.max_by("value", "line_no").alias("value"))
    wide = last.groupBy(run).pivot("metric", [m for m, *_ in METRIC_RULES]).agg(F.first("value"))
    L = lambda c: F.col(c).try_cast("bigint")
    return wide.select(
        run, L("depth").cast("int").alias("depth"), (L("depth") * 64).cast("int").alias("model_dim"),
        L("params_wte").alias("params_wte"), L("params_lm_head").alias("params_lm_head"),
        L("params_total").alias("params_total"), L("num_iterations").alias("num_iterations"),
        L("batch_size").alias("batch_size"), (L("num_iterations") * L("batch_size")).alias("tokens_trained"),
        F.col("val_bpb").try_cast("double").alias("val_bpb"),
        F.coalesce(F.col("core_score").try_cast("double"), F.lit(0.0)).alias("core_score"))


# Report section files in order, and the metrics read from them.
EXPECTED_FILES = [
    "tokenizer-training.md",
    "tokenizer-evaluation.md",
    "base-model-training.md",
    "base-model-loss.md",
    "base-model-evaluation.md",
    "chat-sft.md",
    "chat-evaluation-sft.md",
    "chat-rl.md",
    "chat-evaluation-rl.md",
]
CHAT_METRICS = ["ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval", "ChatCORE"]
STAGE_KEYS = {"base-model-evaluation.md": ("base", ["CORE"]),
              "chat-evaluation-sft.md": ("sft", CHAT_METRICS),
              "chat-evaluation-rl.md": ("rl", ["GSM8K"])}


def report_summary(sections: DataFrame, run: str = "run", match: str = "exact") -> DataFrame:
    """Metric × stage table per run: the text between the first and second
    ':' of the last line carrying the key ('-' if absent). ``match='exact'``
    needs the key before the first ':'; ``'substring'`` keeps the original
    containment rule (so CORE also matches ChatCORE). Rows are ordered CORE
    first, ChatCORE last (``metric_order``)."""
    parts = []
    for f, (stage, keys) in STAGE_KEYS.items():
        s = sections.filter(F.col("file") == f).withColumn("metric", F.explode(F.array(*[F.lit(k) for k in keys])))
        line = F.col("line")
        head = F.trim(F.split(line, ":").getItem(0))
        cond = (head == F.col("metric")) if match == "exact" else line.contains(F.col("metric"))
        parts.append(s.filter(cond & (F.size(F.split(line, ":")) > 1)).select(
            run, F.lit(stage).alias("stage"), "metric", "line_no", F.trim(F.split(line, ":").getItem(1)).alias("value")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    last = u.groupBy(run, "stage", "metric").agg(F.max_by("value", "line_no").alias("value"))
    wide = last.groupBy(run, "metric").pivot("stage", ["base", "sft", "rl"]).agg(F.first("value"))
    order = (F.when(F.col("metric") == "CORE", 0).when(F.col("metric") == "ChatCORE", 2).otherwise(1))
    return wide.select(run, "metric", *[F.coalesce(F.col(s), F.lit("-")).alias(s) for s in ("base", "sft", "rl")],
                       order.alias("metric_order"))


def run_duration(sections: DataFrame, run: str = "run") -> DataFrame:
    """'XhYm' from the header's start stamp to the timestamp of the last
    non-RL section present ('unknown' if either is missing, including when
    that last section has no timestamp)."""
    after = F.trim(F.expr("substr(line, instr(line, ':') + 1)"))
    ts_of = lambda prefix: F.when(F.col("line").startswith(prefix),
                                  F.try_to_timestamp(after, F.lit("yyyy-MM-dd HH:mm:ss")))
    order = F.array_position(F.array(*[F.lit(f) for f in EXPECTED_FILES]), F.col("file"))
    s = sections.withColumn("_ford", order)
    start = (s.filter(F.col("file") == "header.md")
              .select(run, "line_no", ts_of("Run started:").alias("_t")).filter(F.col("_t").isNotNull())
              .groupBy(run).agg(F.min_by("_t", "line_no").alias("start")))
    per_sec = (s.filter((F.col("_ford") > 0) & ~F.col("file").contains("rl"))
                .groupBy(run, "_ford").agg(F.min_by(ts_of("timestamp:"), F.when(ts_of("timestamp:").isNotNull(), F.col("line_no")))
                                           .alias("_t")))
    end = per_sec.groupBy(run).agg(F.max_by("_t", "_ford").alias("end"))
    j = start.join(end, run, "full")
    secs = (F.unix_timestamp("end") - F.unix_timestamp("start"))
    txt = F.concat((secs / 3600).cast("bigint").cast("string"), F.lit("h"),
                   ((secs % 3600) / 60).cast("bigint").cast("string"), F.lit("m"))
    return j.select(run, F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), txt).otherwise(F.lit("unknown"))
                    .alias("duration"))
