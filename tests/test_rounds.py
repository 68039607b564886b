"""Rounds of negative chunks fitted together: derivatives, optimum, planted signal, odd input."""

import random

import numpy as np
from pyspark.sql import functions as F

from clickfeat.operators import evaluate as EVL
from clickfeat.operators import rounds as RO


def _rows(n, seed):
    """One trade in some twelve rows, likelier with ``a`` and without ``b``."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.choice([None, 1, 2, 3])
        p = 1 / (1 + np.exp(-(1.5 * a - (b or 0) - 1.5)))
        out.append((i, int(rng.random() < p), a, b, 7.0))
    return out


SCHEMA = "instance_id long, is_trade int, a double, b int, same double"


def test_derivatives_against_finite_differences():
    rng = np.random.default_rng(4)
    x, chunk = np.hstack([rng.normal(size=(60, 3)), np.ones((60, 1))]), rng.integers(-1, 3, 60)
    w = rng.normal(size=(3, 4))
    _, grad, hess = RO.sums(x, chunk, w)
    for r in range(3):
        for i in range(4):
            up, down = w.copy(), w.copy()
            up[r, i] += 1e-5
            down[r, i] -= 1e-5
            hi, lo = RO.sums(x, chunk, up), RO.sums(x, chunk, down)
            assert abs((hi[0][r] - lo[0][r]) / 2e-5 - grad[r, i]) < 1e-5
            assert np.abs((hi[1][r] - lo[1][r]) / 2e-5 - hess[r, i]).max() < 1e-5


def test_rounds_have_every_positive_and_each_negative_once(spark):
    df = spark.createDataFrame(_rows(2000, 1), SCHEMA).repartition(5)
    chunked = RO.chunks(df, ["instance_id"])
    pos = df.where("is_trade = 1").count()
    sizes = sorted(tuple(r) for r in RO.round_sizes(chunked).collect())
    assert [s[0] for s in sizes] == list(range(-(-(2000 - pos) // pos)))
    assert all(s[1] == pos for s in sizes) and sum(s[2] for s in sizes) == 2000 - pos
    assert chunked.select("instance_id").distinct().count() == chunked.count() == 2000


def test_fit_reaches_the_optimum_of_every_round_and_beats_the_constant(spark):
    df = spark.createDataFrame(_rows(6000, 2), SCHEMA).repartition(5)
    feats = ["a", "b", "same"]
    chunked = RO.chunks(df, ["instance_id"])
    model = RO.fit(chunked, feats, reg=0.5)
    assert len(model.weights) > 2 and model.losses[-1] < model.losses[0]
    # brute force: the gradient of each round, over its training set as it stands, is zero
    own = chunked.toPandas()
    x = np.array([[r.a, -1.0 if np.isnan(r.b) else r.b, r.same] for r in own.itertuples()])
    x = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    total = (own.chunk >= 0).sum()
    for k, w in enumerate(model.weights):
        w = w.copy()
        w[-1] -= np.log((own.chunk == k).sum() / total)
        some = ((own.chunk == k) | (own.chunk == -1)).to_numpy()
        p = 1 / (1 + np.exp(-(x[some] @ w)))
        grad = (p - own.is_trade[some].to_numpy()) @ x[some] + np.array([0.5, 0.5, 0.5, 0]) * w
        assert np.abs(grad).max() < 1e-2 and w[2] == 0
    test = spark.createDataFrame(_rows(3000, 3), SCHEMA)
    scored = RO.score(model, test, keep=["is_trade"])
    base = df.agg(F.avg("is_trade")).first()[0]
    constant = EVL.log_loss(test.select("is_trade", F.lit(base).alias("predicted_score"))).first()["log_loss"]
    assert scored.count() == 3000 and EVL.log_loss(scored).first()["log_loss"] < 0.8 * constant
    # calibrated to all rows, not to the balanced rounds
    assert abs(scored.agg(F.avg("predicted_score")).first()[0] - test.agg(F.avg("is_trade")).first()[0]) < 0.02


def test_rounds_of_odd_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert RO.score(RO.fit(RO.chunks(none, ["instance_id"]), ["a"]), none).count() == 0
    some = spark.createDataFrame([(1, 0, None, None, None), (1, None, float("nan"), 2, 1.0)], SCHEMA)
    scored = RO.score(RO.fit(RO.chunks(some, ["instance_id"]), ["a", "b"]), some).collect()
    assert len(scored) == 2 and all(r["predicted_score"] < 1e-6 for r in scored)
    apart = spark.createDataFrame([(i, int(i > 5), float(i > 5), 0, 0.0) for i in range(12)], SCHEMA)
    ps = {r["instance_id"]: r["predicted_score"] for r in RO.score(RO.fit(RO.chunks(apart, ["instance_id"]), ["a"]), apart).collect()}
    assert max(ps[i] for i in range(6)) < 0.5 < min(ps[i] for i in range(6, 12))
