"""Bounded samples of labelled documents, which the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold

#: Labels of this fold of crc32(doc_id) are never learned from.
FOLDS, HELD_OUT = 5, 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, y of labelled documents outside the held-out fold: about per_class of each class, chosen by hash.

    The labels are sampled before they meet the documents, so that side of the join is bounded by per_class and is
    broadcast; the texts stay where they are. Null labels and null texts are left out, a label counts once per doc_id, and
    of documents that share a labelled doc_id one text, chosen by hash, is learned from.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
    y = y.where(fold("_id", FOLDS) != HELD_OUT).groupBy("_id").agg(F.max("y").alias("y"))
    some = bounded_sample(y, ["y"], per_class)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).select("doc_id", "text", "y")
