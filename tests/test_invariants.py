"""Invariants on the stand-in log (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from clickfeat.operators import counts as C
from clickfeat.operators import encode as EN
from clickfeat.operators import rates as RT
from clickfeat.operators import windows as W
from clickfeat.plans.base import click_log
from clickfeat.plans.features import full_features

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return click_log(spark, SF).cache()


def test_features_keep_rows_and_keys(log):
    out = full_features(log)
    assert out.count() == log.count()
    assert out.select("instance_id").distinct().count() == log.count()


def test_group_size_sum_is_sum_of_squares(log):
    out = C.add_group_sizes(log, {"n": ["user_id", "day"]})
    total = out.agg(F.sum("n")).first()[0]
    sq = log.groupBy("user_id", "day").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert total == sq


def test_history_length_is_ordinal_minus_one(log):
    out = W.add_ordinals(W.add_gaps(log, scopes=("day",)), {"sum_day": ["user_id", "day"]})
    bad = out.where(F.length("history") != F.col("sum_day") - 1).count()
    assert bad == 0
    masked = out.where("day >= 24").select(F.regexp_replace("history", "0", "").alias("h"))
    # histories of masked-day rows only contain masked labels of the same day
    assert masked.where("h != ''").count() == 0


def test_freq_table_totals(log):
    t = RT.feature_value_table(log, ["item_id", "user_id"], min_total=1)
    assert t.where(F.col("Neg") + F.col("Pos") != F.col("Total")).count() == 0
    assert t.agg(F.sum("Total")).first()[0] == 2 * log.count()


def test_codes_have_no_gaps(log):
    out = EN.first_seen_codes(log, ["item_id", "user_id"], ["context_timestamp", "instance_id"], "_c")
    for c in ("item_id", "user_id"):
        n = log.select(c).distinct().count()
        r = out.agg(F.min(f"{c}_c"), F.max(f"{c}_c"), F.countDistinct(f"{c}_c")).first()
        assert tuple(r) == (1, n, n)


def test_shuffled_input_same_result(log):
    a = W.add_ordinals(log).select("instance_id", *W.ORDINALS)
    b = W.add_ordinals(log.repartition(7).orderBy(F.rand(3))).select("instance_id", *W.ORDINALS)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_full_features_hold_the_history_texts(spark):
    from clickfeat.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    full = QUERIES["features_full"](spark, sf)
    for scope, (_, _, name) in W.SCOPES.items():
        texts = {r["instance_id"]: r[name] for r in QUERIES[f"history_{scope}"](spark, sf).collect()}
        assert {r["instance_id"]: r[name] for r in full.select("instance_id", name).collect()} == texts
