"""Data profile (G9-G11): distinct values, daily conversion, user overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """``(field, n_distinct)`` per column.

    Exact: unpivot -> distinct (field, value) -> count per field, i.e. one
    shuffle for all columns.  ``approx=True`` uses HyperLogLog++ sketches
    (no shuffle of values at all) for very wide data.
    """
    if approx:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return row.unpivot([], cols, "field", "n_distinct")
    s = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = s.unpivot([], cols, "field", "value").where(F.col("value").isNotNull())
    return long.distinct().groupBy("field").agg(F.count(F.lit(1)).cast("bigint").alias("n_distinct"))


def daily_cvr(df: DataFrame, day: str = "day", label: str = "is_trade") -> DataFrame:
    """Rows, trades and conversion rate per day."""
    return df.groupBy(day).agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.sum(F.col(label)).cast("bigint").alias("trades"),
        F.round(F.avg(F.col(label).cast("double")), 6).alias("cvr"))


def user_overlap(base: DataFrame, other: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows of ``other`` whose user occurs in ``base``: count and share."""
    users = base.select(user).distinct().withColumn("__hit", F.lit(1))
    j = other.select(user).join(users, user, "left")
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                 F.count("__hit").cast("bigint").alias("overlap_rows"),
                 F.round(F.count("__hit") / F.count(F.lit(1)), 6).alias("share"))
