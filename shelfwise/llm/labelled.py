"""Labelled training rows: a bounded, repeatable sample of the rows a fold leaves for learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """The fold of a document: the checksum of its id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most ``most`` labelled documents outside the held-out fold, by hash of the id.

    Null labels and null ids are left out, as are ids with contradicting labels; repeated ids count once. The sample is
    bounded, so it may be sent to every task.
    """
    chosen = (
        labels.where(f"doc_id is not null and {label} in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("other"))
        .where("y = other")
        .where(fold(modulus) != held)
        .select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("turn"))
        .orderBy("turn", "doc_id")
        .limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")
