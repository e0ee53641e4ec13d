"""Evaluation bundle: task config, random baselines, one JSONL per task.

The config is a few lines of YAML/JSON read through Spark (so it works on
any shared file system) and parsed on the driver; baselines are a CSV; the
items of every task are read in one job, numbered by their line in the
task file.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.index import global_index

ITEM_T = ("struct<query:string,choices:array<string>,gold:int,context_options:array<string>,"
          "continuation:string,context:string>")


def _load_config(spark: SparkSession, path: str) -> list[dict]:
    text = spark.read.option("wholetext", True).text(path).first()[0]
    try:
        import yaml
        cfg = yaml.safe_load(text)
    except ImportError:  # pragma: no cover
        cfg = json.loads(text)
    return cfg["icl_tasks"]


def read_eval_bundle(spark: SparkSession, path: str, tasks: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(meta, items). meta: label, task_type, dataset_uri, num_fewshot (first
    entry of the list), continuation_delimiter (default one space),
    baseline. items: label, idx (line in the task file), item fields."""
    cfg = _load_config(spark, f"{path}/core.yaml")
    rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]),
             t.get("continuation_delimiter", " ")) for t in cfg if tasks is None or t["label"] in tasks]
    meta = spark.createDataFrame(rows, "label string, task_type string, dataset_uri string, num_fewshot int, "
                                       "continuation_delimiter string")
    base = (spark.read.option("header", True).csv(f"{path}/eval_meta_data.csv")
                 .select(F.col("Eval Task").alias("label"), F.col("Random baseline").cast("double").alias("baseline")))
    meta = meta.join(base, "label", "left")
    # Lines are read as splits, so a large task file takes many tasks; a line's place in
    # its task follows from its file, its split's start and its order in the split.
    raw = spark.read.text(f"{path}/eval_data/*").select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = raw.withColumn("dataset_uri", F.element_at(F.split("file", "/"), -2))
    lines = global_index(raw, ["file", "block", "at"], by=["dataset_uri"], idx="idx").drop("file", "block", "at")
    lines = lines.filter(F.trim("line") != "").withColumn("idx", F.col("idx").cast("int"))
    items = (lines.withColumn("item", F.from_json("line", ITEM_T))
                  .join(F.broadcast(meta.select("label", "dataset_uri")), "dataset_uri")  # one row per task
                  .select("label", "idx", "item.*"))
    return meta, items


def write_eval_bundle(spark: SparkSession, path: str, tasks: list[dict], baselines: dict[str, float],
                      items: dict[str, DataFrame]) -> None:
    """Write a bundle in the layout ``read_eval_bundle`` reads (one folder of
    files per dataset, items in the given order over all its files)."""
    cfg = json.dumps({"icl_tasks": tasks}, ensure_ascii=False)
    spark.createDataFrame([(cfg,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/core.yaml")
    spark.createDataFrame(sorted(baselines.items()), "`Eval Task` string, `Random baseline` double") \
         .coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/eval_meta_data.csv")
    for uri, df in items.items():
        (df.orderBy("idx").select(F.to_json(F.col("item")).alias("value"))
           .write.mode("overwrite").text(f"{path}/eval_data/{uri}"))
