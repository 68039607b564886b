"""Shared inputs of the query catalogue: the stand-in log with calendar and
category columns (the reference's ``convert_data`` + ``convert_cat``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickfeat.functions.lists import category_level
from clickfeat.functions.time import time_columns
from clickfeat.sources.standin import events_log


def add_time_and_category(df: DataFrame, ts: str = "context_timestamp", zone: str = "UTC",
                          category_list: str | None = "item_category_list") -> DataFrame:
    cols = time_columns(ts, zone)
    if category_list:
        cols += [category_level(category_list, i).alias(f"category_{i}") for i in range(3)]
    return df.select("*", *cols)


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` stand-in log + ``time, is_week, day, hour, minute,
    half_hour, category_0..2`` (DuckDB twin: ``flog``)."""
    return add_time_and_category(events_log(spark, sf_dir))
