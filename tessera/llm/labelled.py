"""Bounded labelled samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_in, id_text


#: Hash values of labelled ids that go to all executors at most.
SLOTS = 1 << 20


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): rows with an id and a label that are not held out; of
    several labels of an id the least counts."""
    y = F.col(column).cast("int")
    return labels.filter(F.col("doc_id").isNotNull() & y.isNotNull() & ~held_out(F.col("doc_id").cast("long"))).groupBy(id_in().alias("doc_id")).agg(F.min(y).alias("y"))


def training_texts(docs: DataFrame, labels: DataFrame, column: str, bound: int | None = None) -> DataFrame:
    """(doc_id, text, y) of labelled documents, without held-out ones; with
    ``bound``, of that many labels with the least hash of the id, so that ids
    and texts of a sample are bounded whatever the table's size."""
    own = training_labels(labels, column)
    texts = id_text(docs)
    if bound is not None:
        own = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    else:  # texts whose id can't have a label don't travel to the join
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
        texts = texts.withColumn("slot", slot).join(F.broadcast(own.select(slot).distinct()), "slot", "left_semi")
    return texts.join(own if bound is not None else own.hint("merge"), "doc_id").select("doc_id", "text", "y")
