"""Labelled rows for fitting, bounded in number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for testing: crc32 of the id as text is divisible by 5; a null id is not kept."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All rows if there are at most `most`, else about nine tenths of that many, by a hash of `keys`.

    Rows are counted, then filtered: no task and no driver ever holds more than the
    sample. The limit at the end is a promise that the filter as good as always keeps.
    """
    total, steps = rows.count(), 1 << 40
    if total <= most:
        return rows
    share = int(steps * 0.9 * most / total)
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(steps)) < share).limit(most)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents outside the held-out fold.

    Which rows is decided by a hash of the id, the same on every run. So many ids
    and labels at most are broadcast; the documents are not moved.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(sampled(known, ["doc_id"], rows)), "doc_id")
