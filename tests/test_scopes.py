"""Order features of many scopes: one sort for all of them, the same as a window for each."""

import random

from pyspark.sql import Window, functions as F

from clickfeat.operators import ordered as O

SPECS = {"a": (["user_id"], O.ORDER), "b": (["user_id", "day"], O.ORDER), "c": (["kind", "user_id"], O.ORDER),
         "d": (["user_id", "score", "day"], O.ORDER), "e": (["day", "user_id"], ("n",))}


def _rows(n):
    rng = random.Random(6)
    return [(i, rng.choice([None, 1, 2, 3, 3, 3]), rng.choice([None, 1, 2]), rng.choice([None, "x", "é", ""]),
             rng.choice([None, 0.0, -0.0, float("nan"), 1.5]), rng.choice([None, *range(20)]), i % 2) for i in range(n)]


def _windows(df):
    cols = []
    for name, (keys, wanted) in SPECS.items():
        group = Window.partitionBy(*keys)
        w, t = group.orderBy("context_timestamp", "instance_id"), F.col("context_timestamp")
        make = {"rn": F.row_number().over(w).cast("bigint"), "prev": F.lag(t).over(w), "next": F.lead(t).over(w),
                "n": F.count(F.lit(1)).over(group).cast("bigint"), "first": F.min(t).over(group), "last": F.max(t).over(group)}
        cols += [make[c].alias(f"{name}__{c}") for c in wanted]
    return df.select("*", *cols)


def test_scopes_equal_windows_and_need_none(spark, monkeypatch):
    df = spark.createDataFrame(_rows(700), "instance_id long, user_id int, day int, kind string, score double, context_timestamp long, is_trade int")
    want = sorted(_windows(df).drop("score").collect(), key=lambda r: r.instance_id)
    for batch, cut in ((O.BATCH_ROWS, None), (7, None), (50, 20)):  # one, many and cut anchors a batch
        monkeypatch.setattr(O, "BATCH_ROWS", batch)
        got = O.add_scopes(df, SPECS, chunk_rows=cut)
        assert got.drop("score").columns == list(want[0].__fields__)
        assert sorted(got.drop("score").collect(), key=lambda r: r.instance_id) == want
    # the cost: one sort, not one for each scope
    plan = O.add_scopes(df, SPECS, chunk_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1
