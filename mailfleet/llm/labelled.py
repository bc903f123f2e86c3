"""Labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold_of(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, max_rows: int, held_out_fold: int = 0,
) -> DataFrame:
    """``text, y`` of at most ``max_rows`` labelled ids outside the held-out fold.

    The ids are those first in the order of their hashes, so they do not depend on how tables are
    split. Null labels and ids are left out; an id labelled more than once counts as 1 if any label
    is. ``docs`` has ``doc_id`` and ``_text``; rows that repeat an id all count.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_y").isNotNull() & (fold_of(F.col("_id")) != held_out_fold))
    chosen = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # At most max_rows pairs of numbers: small enough to be sent everywhere.
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select(
        "_text", F.col("_y").alias("y"))
