"""Row hygiene, splits, unions and key-set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (ties: remaining columns).

    ``min(struct(order…, rest…))`` per key is an ordinary aggregate: partial
    aggregation runs map-side, so a key holding a third of all rows costs one
    row per task in the shuffle (a ``row_number`` window would send the whole
    group to one task).
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("__best")
    g = df.groupBy(*keys).agg(best)
    return g.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in order + rest]).select(*df.columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct (hash aggregate with map-side combine)."""
    return df.distinct()


def split_by_day(df: DataFrame, holdout_day: int = 24, day: str = "day") -> tuple[DataFrame, DataFrame]:
    """``day < d`` (train) and ``day == d`` (holdout/test).

    On a stage written with ``partitionBy(day)`` both filters prune
    partitions at the scan.
    """
    return df.where(F.col(day) < holdout_day), df.where(F.col(day) == holdout_day)


def tag_split(df: DataFrame, holdout_day: int = 24, day: str = "day", tag: str = "part") -> DataFrame:
    """Both halves of ``split_by_day`` in one frame, tagged ``train``/``holdout``."""
    d = F.col(day)
    return (df.where(d <= holdout_day)
              .withColumn(tag, F.when(d < holdout_day, F.lit("train")).otherwise(F.lit("holdout"))))


def exclude_ids(df: DataFrame, ids, key: str = "instance_id") -> DataFrame:
    """P5: drop rows whose key is in an explicit id list (or id DataFrame)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")
    lst = df.sparkSession.createDataFrame([(i,) for i in ids], df.select(key).schema)
    return df.join(lst, key, "left_anti")  # Spark knows the bytes of a local list


def anti_by_key(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    return df.join(other.select(*([keys] if isinstance(keys, str) else keys)), keys, "left_anti")


def split_by_label_null(df: DataFrame, label: str = "is_trade") -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled)."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())


def fill_label(df: DataFrame, label: str = "is_trade") -> DataFrame:
    """Missing label -> 0, as int."""
    return df.withColumn(label, F.coalesce(F.col(label), F.lit(0)).cast("int"))


def fill_sentinel(df: DataFrame, value: int = -1, subset: list[str] | None = None) -> DataFrame:
    """Every missing numeric value -> ``value`` (``fillna(-1)``)."""
    return df.fillna(value, subset=subset)


def replace_sentinel(df: DataFrame, col: str, sentinel=-1, value=0) -> DataFrame:
    """P10: ``sentinel`` -> ``value`` in one column."""
    c = F.col(col)
    return df.withColumn(col, F.when(c == sentinel, F.lit(value)).otherwise(c))


def feature_columns(df: DataFrame, exclude) -> list[str]:
    """All columns but the excluded ones, in frame order."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def union_train_test(train: DataFrame, test: DataFrame, tag: str | None = "src") -> DataFrame:
    """Union by name, test may lack columns (the label); optional tag."""
    if tag:
        train = train.withColumn(tag, F.lit("train"))
        test = test.withColumn(tag, F.lit("test"))
    return train.unionByName(test, allowMissingColumns=True)
