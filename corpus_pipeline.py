"""A training-corpus pipeline over ``documents``: five stages, each calling one
operator of ``tessera.llm`` and working on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``; where a stage changes a text, n_chars follows it.
Defined results: rows that repeat a doc_id share its fate, null texts are empty
ones, texts of any length are worked on whole, and empty tables pass through. Further
columns of any name travel along untouched up to the packing, which gives pieces. Of
a group of near copies with the same smallest id all rows of that id stay.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import decontam, linededup, nbsvm, packing, simhash  # noqa: E402
from tessera.llm.common import id_in, scratch, table  # noqa: E402
from tessera.session import ship_package  # noqa: E402


#: A document goes if the quality classifier gives it less than this.
QUALITY = 0.7


def _less(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the doc_ids of ``gone``; null is an id like any other."""
    ids = gone.select(id_in().alias("__row_id")).distinct()
    return docs.withColumn("__row_id", id_in()).join(ids, "__row_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the
    labels of this stage's documents that are not held out."""
    scores = nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))
    return _less(docs, scores.filter(F.col("score") < QUALITY))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all but the last document that holds them; a
    document that loses all its text goes."""
    return linededup.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), shingle=4, radius=4)
    return _less(docs, groups.filter("not doc_id <=> component_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, up to its error budget, go."""
    return _less(docs, decontam.matches(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packed)]
#: SQL has no classifier training, SimHash or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark, ("corpus_pipeline.py",))
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
