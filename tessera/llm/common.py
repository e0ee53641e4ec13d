"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, ship_package

#: Stands for a null doc_id inside the operators: below every real id.
NULL_ID = -(1 << 63)
#: Rows hold whole texts, so an Arrow batch of them is kept small.
BATCH_ROWS = 2000
#: The white space of the word and line rules: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, codec: str = "") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends
    there, and a lost executor costs no more than its running tasks."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=codec or None)
    return spark.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> None:
    """Make the package importable on the executors, and cap the rows of an
    Arrow batch at BATCH_ROWS (a lower setting stays)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_in(col: str | Column = "doc_id") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def id_out(col: str | Column = "doc_id") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != F.lit(NULL_ID), c)


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) and nothing else, so that further columns of
    the input can't clash; a null id becomes NULL_ID, a null text stays null."""
    ready(docs.sparkSession)
    return docs.select(id_in().alias("doc_id"), F.col("text").cast("string").alias("text"))


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
             "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "float": pa.float32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def encoded(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
