"""Training rows: fixed folds and bounded, documented samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def drawn(key: Column, share: Column) -> Column:
    """Whether a row with this hash belongs to a sample of this share; shares may be as small as 1e-15."""
    return F.shiftrightunsigned(key, 1).cast("double") < share * F.lit(2.0**63)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """doc_id, text, label of about ``bound`` labelled documents for which ``keep`` holds; all, where there are fewer.

    The choice is by a hash of doc_id, so it is the same on every run. The chosen ids (at most about ``bound``, whatever
    the input) go to all tasks, so no other text is dealt. Rows of one doc_id with different labels count once each; of
    several texts of one doc_id the first in order counts, so repeated rows do not enlarge the sample.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & keep).distinct()
    share = min(1.0, bound / max(1, rows.count()))
    chosen = rows.where(drawn(F.xxhash64("doc_id"), F.lit(share)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
