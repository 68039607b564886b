"""Readers and writers.

Text files are space-delimited with a header, as the reference's; every
read takes an explicit schema.  Stages are Parquet partitioned by ``day``
so train/holdout filters prune partitions at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickfeat.schema import FREQ_TABLE, PREDICTIONS, RAW_LOG


# Our own text stages mark NULL explicitly so that an empty string (the
# first click's empty history) survives the round trip as an empty string;
# the reference lost that distinction (its empty field came back missing).
STAGE_NULL = "\\N"


def read_log(spark: SparkSession, path: str, schema: T.StructType = RAW_LOG, sep: str = " ",
             null_value: str = "") -> DataFrame:
    """Header + space-delimited log with an explicit schema.

    ``null_value=""``: an empty field is missing (files written by pandas)."""
    return (spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "FAILFAST")
            .option("nullValue", null_value).csv(path))


def write_log(df: DataFrame, path: str, sep: str = " ", null_value: str = "") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("nullValue", null_value).csv(path)


def write_stage(df: DataFrame, path: str, partition: str = "day") -> None:
    """K1: feature stage, one folder per day (truncates lineage between phases)."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Parquet keeps every column type, history strings stay strings."""
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str, with_label: bool = False) -> None:
    """K2: ``instance_id [is_trade] predicted_score``, space-delimited."""
    cols = ["instance_id", "is_trade", "predicted_score"] if with_label else ["instance_id", "predicted_score"]
    write_log(df.select(*cols), path)


def read_predictions(spark: SparkSession, path: str, with_label: bool = False) -> DataFrame:
    """A prediction table written by ``write_predictions``."""
    fields = [f for f in PREDICTIONS.fields if with_label or f.name != "is_trade"]
    return read_log(spark, path, T.StructType(fields))


def write_freq_table(df: DataFrame, path: str) -> None:
    """K3: ``Field Value Neg Pos Total Ratio`` sorted by Total ascending."""
    write_log(df.orderBy("Total", "Field", "Value"), path)


def read_freq_table(spark: SparkSession, path: str) -> DataFrame:
    """S6."""
    return read_log(spark, path, FREQ_TABLE)


def read_leaf_features(spark: SparkSession, path: str, n_trees: int) -> DataFrame:
    """S3: ``instance_id is_trade xgb_1..xgb_n`` with the label dropped."""
    schema = T.StructType([T.StructField("instance_id", T.LongType()), T.StructField("is_trade", T.IntegerType())]
                          + [T.StructField(f"xgb_{i}", T.IntegerType()) for i in range(1, n_trees + 1)])
    return read_log(spark, path, schema).drop("is_trade")
