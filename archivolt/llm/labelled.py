"""Labelled rows to learn from: folds and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.tables import fold_of


def held_out(key: Column, folds: int, fold: int, inverse: bool = False) -> Column:
    """Whether a row's fold is ``fold``; a row without a key is held out."""
    return F.coalesce(fold_of(key, folds) == fold, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``per_class`` rows of either label outside ``fold``.

    The rows with the smallest hashes of their ids are taken, so the sample is
    the same for any order or partitioning.  Its size is bounded by the
    parameter, so the ids can be broadcast.  Labels other than 0 and 1 and rows
    without an id are passed over; a document with two labels counts for each.
    Of documents with one id, however many, the smallest text is taken.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("_id"), folds, fold))
    # Ties go by id; a label row that repeats counts once.
    rows = rows.distinct().withColumn("_place", F.xxhash64("_id"))
    one = lambda value: rows.where(F.col("label") == value).orderBy("_place", "_id").limit(per_class)
    chosen = one(0).unionByName(one(1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"])
    return found.groupBy("doc_id", "label", "_place").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "_place")


def rate(labels: DataFrame, label: str, folds: int, fold: int) -> float:
    """Share of label 1 among the rows outside ``fold``, kept away from 0 and 1."""
    rows = labels.where(~held_out(F.col("doc_id"), folds, fold)).where(F.col(label).isin(0, 1))
    ones, n = rows.agg(F.sum(F.col(label).cast("int")), F.count("*")).first()
    return ((ones or 0) + 1) / (n + 2)
