"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's digits, modulo `modulus`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def labelled(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, label, text) of at most `rows` labelled documents outside the held-out fold.

    The rows are those whose ids hash lowest; so many ids at most are broadcast."""
    chosen = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    chosen = chosen.groupBy("doc_id").agg(F.max(target).cast("int").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
