"""Labelled documents for fitting classifiers: the training rows, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of `labels` that a sample has at most: those with the least hash of doc_id.
SAMPLE_ROWS = 20_000


def fold(modulus: int):
    """crc32 of the doc_id as text, modulo; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(0))


def training(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """doc_id, label of the training rows: rows of the held-out fold and null labels never count."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return chosen.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(modulus) != held))


def sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of the sampled training rows.

    The sample has `rows` rows at most, so its ids are safe to broadcast.
    """
    chosen = training(labels, label, modulus, held).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
