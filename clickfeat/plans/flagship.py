"""The flagship plan: day-scope gaps, history and ordinal of every click."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickfeat.operators import windows as W
from clickfeat.plans.base import click_log


def flagship(spark: SparkSession, sf_dir: str, mask_day: int = 24) -> DataFrame:
    df = click_log(spark, sf_dir)
    df = df.select("instance_id", "user_id", "day", "context_timestamp", "is_trade")
    df = W.add_gaps(df, scopes=("day",), mask_day=mask_day)
    df = W.add_ordinals(df, {"sum_day": ["user_id", "day"]})
    return df.select("instance_id", "diff_1", "diff_2", "diff_3", "diff_4", "history", "sum_day",
                     "sum_first_day", "sum_last_day")
