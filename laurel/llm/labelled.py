"""Labelled documents that may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.tables import staged

FOLDS = 5
LABELLED = 400_000  # rows to learn from at most (about: chosen by hash)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo five; fold 0 is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def sample(labels: DataFrame, mark: str, bound: int = LABELLED) -> DataFrame:
    """``_id`` and ``mark`` (0 or 1) of the labels outside fold 0, staged.

    Up to ``bound`` rows all are taken, beyond that about so many, by a hash of the id: the table may
    be broadcast. Null ids and marks are left out; an id that is marked twice has the larger mark.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull()).where(fold(F.col("doc_id")) != 0)
    rows = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(mark).cast("int")).alias(mark))
    share = bound / max(labels.count(), 1)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return staged(rows, "labelled")
