"""Evaluation and blending of score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-15  # probability clip, as the usual log-loss implementation


def log_loss_term(label: str = "is_trade", score: str = "predicted_score", eps: float = EPS) -> Column:
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))


def log_loss(df: DataFrame, label: str = "is_trade", score: str = "predicted_score", by=None) -> DataFrame:
    """M2: mean binary cross-entropy, overall or per group (one aggregate)."""
    agg = [F.avg(log_loss_term(label, score)).alias("log_loss"), F.count(F.lit(1)).cast("bigint").alias("rows")]
    return df.groupBy(*(by or [])).agg(*agg)


def accuracy(df: DataFrame, label: str = "is_trade", score: str = "predicted_score",
             threshold: float = 0.5, by=None) -> DataFrame:
    """M6: share of rows where ``score > threshold`` equals the label."""
    hit = ((F.col(score) > threshold).cast("int") == F.col(label)).cast("double")
    return df.groupBy(*(by or [])).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).cast("bigint").alias("rows"))


def blend(tables: list[tuple[DataFrame, float]], key: str = "instance_id",
          score: str = "predicted_score", how: str = "inner") -> DataFrame:
    """``sum(w_i * score_i)`` after a **key** join (never by row position)."""
    out = None
    expr = None
    for i, (t, w) in enumerate(tables):
        t = t.select(key, F.col(score).alias(f"__s{i}"))
        out = t if out is None else out.join(t, key, how)
        term = F.lit(float(w)) * F.col(f"__s{i}")
        expr = term if expr is None else expr + term
    return out.select(key, expr.alias(score))


def attach_scores(rows: DataFrame, scores: DataFrame, key: str = "instance_id") -> DataFrame:
    """Keep every submission row; scores joined by key (NULL if absent)."""
    return rows.join(scores, key, "left")


def mean_adjust(scores: DataFrame, target_rate: float, score: str = "predicted_score") -> DataFrame:
    """Notes' idea: rescale scores so their mean equals ``target_rate`` (e.g.
    the conversion rate of the latest training day, given the declining daily
    trend).  One aggregate gives the current mean; two scalars reach the driver."""
    mean = scores.agg(F.avg(score)).first()[0]
    factor = (target_rate / mean) if mean else 1.0
    return scores.withColumn(score, F.col(score) * F.lit(factor))


def latest_day_rate(df: DataFrame, before_day: int, day: str = "day", label: str = "is_trade") -> float:
    """Conversion rate of the last day before ``before_day`` (one small aggregate)."""
    r = (df.where(F.col(day) < before_day).groupBy(day).agg(F.avg(F.col(label).cast("double")).alias("r"))
           .orderBy(F.col(day).desc()).limit(1).collect())
    return float(r[0]["r"]) if r else 0.0
