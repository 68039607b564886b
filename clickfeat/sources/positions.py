"""Row positions of a file source: the order in which rows stand in the files,
for "keep the first", "first appearance" and "in the order of the submission".

A row's place is (file, start of its split, place in the split).  The rows are
written once with these three; a summary of one row a split then gives every
split the rows before it, and the position is their sum with the place.  No
row is sorted or shuffled for it (the summary is broadcast up to a measured
size and joined beyond).  Files come in the order of their names, as Spark's
writers number them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clickfeat.operators.encode import BROADCAST_BYTES, staged


def with_positions(scan: DataFrame, name: str = "position") -> DataFrame:
    """``scan`` (as ``spark.read`` returns it: text, CSV, Parquet, ...) with the
    0-based position of every row; empty files and no files are fine."""
    cols = scan.columns
    rows = staged(scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
                              F.monotonically_increasing_id().alias("__mid")), "positions")
    # a split is read in one go, so its rows have consecutive ids
    splits = rows.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    splits = staged(splits, "splits")
    before = F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("__file", "__start", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    if splits.count() * 256 <= BROADCAST_BYTES:
        splits = F.broadcast(splits)
    position = (F.col("__before") + F.col("__mid") - F.col("__first")).cast("bigint").alias(name)
    return rows.join(splits, ["__file", "__start"]).select(*cols, position)


def in_order(df: DataFrame, name: str = "position") -> DataFrame:
    """``df`` dealt by range of ``name`` and sorted in each part, so that the files it
    is written to hold the rows in that order."""
    return df.repartitionByRange(name).sortWithinPartitions(name)
