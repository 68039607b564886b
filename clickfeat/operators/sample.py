"""Balanced negative chunks (Z2): every positive plus one chunk of negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickfeat.operators.encode import consecutive_index


def negative_chunks(df: DataFrame, chunk_size: int, order: list[str], label: str = "is_trade") -> DataFrame:
    """Adds ``chunk``: negatives numbered in ``order`` and cut into chunks of
    ``chunk_size`` (the last one partial - the reference dropped it);
    positives get ``-1`` (they belong to every chunk).  Numbering is
    distributed (range sort + per-partition offsets)."""
    neg = consecutive_index(df.where(F.col(label) != 1), order, "__idx")
    neg = neg.withColumn("chunk", F.floor((F.col("__idx") - 1) / chunk_size).cast("bigint")).drop("__idx")
    pos = df.where(F.col(label) == 1).withColumn("chunk", F.lit(-1).cast("bigint"))
    return neg.unionByName(pos)


def chunk_training_set(chunked: DataFrame, k: int) -> DataFrame:
    """Training rows of round ``k``: all positives and negatives of chunk ``k``."""
    return chunked.where((F.col("chunk") == k) | (F.col("chunk") == -1))
