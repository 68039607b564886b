"""Bagged training over balanced negative chunks.

Every round has all positives and one chunk of the negatives.  The reference
trains one model in turn on each round; here the rounds are the bags of one
distributed job: logistic models, one a round, fitted together by Newton steps.
A step is one scan of the staged features against all rounds' weights: a
negative adds to its own round's gradient and Hessian, a positive to every
round's, as matrix products over a batch - no row is ever repeated for a round.
A task hands over one row a round, added up by an aggregate.

What is small: rounds (at most ``MAX_ROUNDS``; chunks grow instead) times features
squared, both parameters and not sizes of the data.  Only that is solved on the
driver and sent to the tasks.

A round has fewer negatives than the log, so its intercept is moved by the log
of the share it has of them; scores are the mean probability of all rounds.
NULL labels count as 0 and missing features as -1; a constant feature has
weight 0; without positives or negatives nothing is fitted and scores are the
label's mean.  Rows may share a key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickfeat.operators.encode import staged
from clickfeat.operators.sample import chunk_training_set, negative_chunks

MAX_ROUNDS = 64
BATCH = 4096


@dataclass
class Rounds:
    """Weights of all rounds, the last one the intercept, on standardised features."""
    features: list
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray   # rounds x (features + 1)
    losses: list          # mean log-loss of the rounds before each step


def chunks(df: DataFrame, order: list[str], label: str = "is_trade", ratio: float = 1.0) -> DataFrame:
    """Rows with their ``chunk`` (positives: -1).  A chunk has ``ratio`` negatives a
    positive, or more where that would make over ``MAX_ROUNDS`` rounds."""
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    n = df.agg(F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y != 1, 1)).alias("neg")).first()
    size = max(1, math.ceil(ratio * n["pos"]), -(-n["neg"] // MAX_ROUNDS))
    return staged(negative_chunks(df.withColumn(label, y), size, order, label), "rounds")


def round_sizes(chunked: DataFrame, label: str = "is_trade") -> DataFrame:
    """``chunk, positives, negatives`` of every round's training set."""
    last = chunked.agg(F.max("chunk")).first()[0]
    out = None
    for k in range(0 if last is None else last + 1):  # at most MAX_ROUNDS
        one = chunk_training_set(chunked, k).agg(F.count(F.when(F.col(label) == 1, 1)).alias("positives"),
                                                 F.count(F.when(F.col(label) != 1, 1)).alias("negatives"))
        one = one.select(F.lit(k).cast("bigint").alias("chunk"), "positives", "negatives")
        out = one if out is None else out.unionByName(one)
    return out


def _matrix(df: DataFrame, features: list[str], *more) -> DataFrame:
    return df.select(*more, F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(-1.0))
                                      for c in features]).alias("x"))


def _standard(column, mean, scale) -> np.ndarray:
    """A batch's features standardised, with a column of ones."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(mean))
    return np.hstack([(x - mean) / scale, np.ones((len(x), 1))])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def sums(x: np.ndarray, chunk: np.ndarray, weights: np.ndarray):
    """Loss, gradient and Hessian of every round on some rows (``chunk`` -1: positive)."""
    rounds, d = weights.shape
    loss, grad, hess = np.zeros(rounds), np.zeros((rounds, d)), np.zeros((rounds, d, d))
    pos = x[chunk < 0]
    for r in range(rounds):
        for part, y in ((pos, 1.0), (x[chunk == r], 0.0)):
            if len(part):
                z = part @ weights[r]
                p = _sigmoid(z)
                loss[r] += np.logaddexp(0, z if y == 0 else -z).sum()
                grad[r] += (p - y) @ part
                hess[r] += (part * (p * (1 - p))[:, None]).T @ part
    return loss, grad, hess


def _summed(shared, mean, scale):
    def run(batches):
        w = shared.value
        total = None
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                new = sums(_standard(part.column("x"), mean, scale), part.column("chunk").to_numpy(), w)
                total = new if total is None else tuple(a + c for a, c in zip(total, new))
        if total is not None:
            flat = np.hstack([total[0][:, None], total[1], total[2].reshape(len(w), -1)])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(w)), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], ["round", "s"])
    return run


def fit(chunked: DataFrame, features: list[str], steps: int = 8, reg: float = 1.0) -> Rounds:
    """The models of all rounds of ``chunks``' rows.  ``reg / 2`` times the squared
    weights (not the intercept) is added to every round's loss."""
    spark, d = chunked.sparkSession, len(features)
    rows = staged(_matrix(chunked, features, F.col("chunk")), "rounds-matrix")
    # one row of two numbers a feature
    at = [F.col("x")[i] for i in range(d)]
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.max("chunk").alias("last"), F.count(F.when(F.col("chunk") < 0, 1)).alias("pos"),
                 *[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([m[f"s{i}"] or 0.0 for i in range(d)])
    scale[scale == 0] = np.inf
    if not m["n"] or m["last"] < 0 or not m["pos"]:
        share = m["pos"] / m["n"] if m["n"] else 0.5
        w = np.zeros((1, d + 1))
        w[0, -1] = np.clip(np.log(max(share, 1e-15) / max(1 - share, 1e-15)), -35, 35)
        return Rounds(features, mean, scale, w, [])
    negatives = {r["chunk"]: r["c"] for r in rows.where("chunk >= 0").groupBy("chunk").agg(F.count(F.lit(1)).alias("c")).collect()}
    rounds = m["last"] + 1
    size = np.array([m["pos"] + negatives[k] for k in range(rounds)], dtype=float)
    weights, losses, ridge = np.zeros((rounds, d + 1)), [], np.append(np.full(d, reg), 1e-9)
    width, best = 1 + (d + 1) + (d + 1) ** 2, None
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)
        part = rows.mapInArrow(_summed(shared, mean, scale), "round int, s array<double>")
        added = part.groupBy("round").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]) if width <= 64 else (
            part.select("round", F.posexplode("s").alias("i", "v")).groupBy("round", "i").agg(F.sum("v").alias("v"))
                .groupBy("round").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda t: t.v).alias("s")))
        s = np.array([list(r)[1:] if width <= 64 else r["s"] for r in sorted(added.collect(), key=lambda r: r["round"])])
        shared.destroy()
        loss = s[:, 0] + (ridge * weights ** 2).sum(axis=1) / 2
        losses.append(float((s[:, 0] / size).mean()))
        if best is not None:  # a round whose step went too far goes back half the way
            worse = loss > best[0] + 1e-9 * size
            best = tuple(np.where(worse.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in
                         zip(best, (loss, weights, s[:, 1:d + 2], s[:, d + 2:].reshape(rounds, d + 1, d + 1), np.ones(rounds))))
            best[4][worse] /= 2
        else:
            best = (loss, weights, s[:, 1:d + 2], s[:, d + 2:].reshape(rounds, d + 1, d + 1), np.ones(rounds))
        _, base, grad, hess, pace = best
        step = np.array([np.linalg.solve(h + np.diag(ridge), g + ridge * w) for h, g, w in zip(hess, grad, base)])
        weights = base - pace[:, None] * step
        if np.abs(weights - base).max() < 1e-6:
            break
    # from the share of negatives that a round has to that of the log
    whole = sum(negatives.values())
    weights[:, -1] += np.log([negatives[k] / whole for k in range(rounds)])
    return Rounds(features, mean, scale, weights, losses)


def score(model: Rounds, df: DataFrame, key: str = "instance_id", keep=()) -> DataFrame:
    """``key [keep] predicted_score``: the mean probability of the rounds, one scan."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Rounds = shared.value
        for b in batches:
            n = b.num_columns - 1
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                p = _sigmoid(_standard(part.column("x"), m.mean, m.scale) @ m.weights.T).mean(axis=1)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n)], pa.array(p, pa.float64())],
                                                 [*part.schema.names[:n], "predicted_score"])
    rows = _matrix(df, model.features, key, *keep)
    out = rows.drop("x").withColumn("predicted_score", F.lit(0.0).cast("double")).schema
    return rows.mapInArrow(run, out)
