"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickfeat.session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: with it Spark drops a query's shuffle files as it ends, else once the driver happens to collect its garbage
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``staged``, without shuffle files left behind, and the folder, for ``drop_scratch`` once
    all that reads it is written itself."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        return _staged(df, name)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared scratch folder and read back: cuts
    the lineage in a form that survives lost executors."""
    return _staged(df, name)[0]


def fold(key: str, n: int):
    """``crc32`` of an id written as text, modulo ``n`` (null id: fold 0)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(0))
