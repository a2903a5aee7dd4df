"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, column: str, allowed: Column, per_class: int) -> DataFrame:
    """text and label (0 or 1) of at most per_class documents of each label, first by a hash of doc_id.

    allowed is a condition on doc_id. Rows without label or text are no examples; a
    document with several label rows is an example for each. The chosen ids are at
    most 2 x per_class and so are broadcast; documents don't move.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    pick = lambda v: known.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).union(pick(1)).withColumnRenamed("doc_id", "__id")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label").filter(F.col("text").isNotNull())
