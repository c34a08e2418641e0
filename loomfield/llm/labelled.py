"""Labelled rows for the two classifiers: which rows are held out, and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def sample_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids that are not held out, the first by a hash of the id: (doc_id, y).

    This bound is on what the model is fitted to, not on what it scores. Ids with contradicting labels are left out.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    one = usable.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sample_documents(docs: DataFrame, chosen: list, columns: list[Column]) -> DataFrame:
    """doc_id, y and ``columns`` of the documents with an id in ``chosen`` (doc_id, y), one row an id: of several texts that with the smallest hash.

    ``chosen`` is the bounded sample, so it may be broadcast.
    """
    small = docs.sparkSession.createDataFrame([(int(i), int(y)) for i, y in chosen], "__id long, y int")
    joined = docs.select(F.col("doc_id").alias("__doc"), *[c for c in docs.columns if c == "text"]).join(F.broadcast(small), F.col("__doc") == F.col("__id"))
    each = joined.select(F.col("__doc").alias("doc_id"), "y", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.struct(*columns).alias("v"))
    return each.groupBy("doc_id", "y").agg(F.min_by("v", "tie").alias("v")).select("doc_id", "y", "v.*")
