"""JSON-lines chat data and caption annotation files.

Lines are parsed with ``from_json`` (never a Python loop): a line is either a
bare array of messages or an object with ``messages`` plus metadata. Blank
lines are skipped; lines that do not parse are kept with ``valid = false``
so a job can count or drop them instead of dying.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MSGS_T = "array<struct<role:string,content:string>>"
OBJ_T = f"struct<image_id:string,messages:{MSGS_T}>"
ANN_T = ("images array<struct<id:long>>, "
         "annotations array<struct<id:long,image_id:long,caption:string>>")


def parse_chat_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    v = F.trim(F.col(col))
    first = F.substring(v, 1, 1)
    arr = F.when(first == "[", F.from_json(v, MSGS_T))
    obj = F.when(first == "{", F.from_json(v, OBJ_T))
    image_id = obj["image_id"]
    return (lines.filter(F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", "") != "")
                 .select(F.col(col).alias("line"),
                         F.coalesce(arr, obj["messages"]).alias("messages"),
                         image_id.try_cast("bigint").alias("image_id"))
                 .withColumn("valid", F.col("messages").isNotNull()))


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, messages, image_id, valid) for every non-blank line."""
    return parse_chat_lines(spark.read.text(path))


def to_chat_json(convs: DataFrame, with_metadata: bool = True) -> DataFrame:
    msgs = F.transform(F.col("messages"), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    if with_metadata:
        js = F.when(F.col("image_id").isNotNull(),
                    F.to_json(F.struct(F.col("image_id").alias("image_id"), msgs.alias("messages")))
                    ).otherwise(F.to_json(msgs))
    else:
        js = F.to_json(msgs)
    return convs.select(js.alias("value"))


def write_chat_jsonl(convs: DataFrame, path: str, with_metadata: bool = True, mode: str = "overwrite") -> None:
    """One JSON per line, non-ASCII kept; the object form carries image_id."""
    to_chat_json(convs, with_metadata).write.mode(mode).text(path)


def read_caption_annotations(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """``images`` (image_id) and ``annotations`` (ann_id, image_id, caption)
    from COCO-style files. A file may hold one document (``multi_line``) or
    one partial ``{images, annotations}`` object per line; either way both
    arrays are exploded and rows with a null id are skipped."""
    raw = spark.read.schema(ANN_T).option("multiLine", multi_line).json(path)
    images = (raw.select(F.explode("images").alias("i"))
                 .select(F.col("i.id").alias("image_id")).filter(F.col("image_id").isNotNull()))
    anns = (raw.select(F.explode("annotations").alias("a"))
               .select(F.col("a.id").alias("ann_id"), F.col("a.image_id").alias("image_id"),
                       F.coalesce(F.col("a.caption"), F.lit("")).alias("caption"))
               .filter(F.col("image_id").isNotNull()))
    return images, anns
