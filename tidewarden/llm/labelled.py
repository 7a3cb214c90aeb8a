"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(id_col: str, parts: int) -> Column:
    """CRC32 of the id as text, modulo parts; 0 for a null id is never asked for, as such rows have no label."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def bounded(labels: DataFrame, id_col: str, label_col: str, train: Column, most: int) -> DataFrame:
    """At most `most` labelled ids of the training rows, in the order of a hash of the id: id, label.

    An id with several labels has the largest; null ids and labels are left out.
    """
    rows = labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("id"), "id").limit(most)


def with_text(sample: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of a bounded sample. The sample is bounded by its limit, so it may be sent to every task."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(sample), "id").select("id", "label", F.coalesce("text", F.lit("")).alias("text"))
