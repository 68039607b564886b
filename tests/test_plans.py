"""Plan-shape regression tests: the physical plans keep the properties the
design relies on (shared exchanges, shuffle-free lookups, pruning)."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from clickfeat.operators import windows as W
from clickfeat.plans.base import click_log
from clickfeat.session import scratch_path
from clickfeat.sources import logs as IO
from clickfeat.operators import rows as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _no_cache(spark):
    # cached relations from other test modules would change the plans
    spark.catalog.clearCache()


def _plan(df, run=False):
    """The physical plan as ``explain()`` prints it: the planned exchanges and
    joins (AQE may later only coalesce partitions or demote joins to
    broadcasts).  ``run=True`` executes first and keeps the final plan."""
    if run:
        df.write.format("noop").mode("overwrite").save()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return final_plan(buf.getvalue())


def final_plan(text):
    """After execution AQE prints the final and the initial plan: keep the final one."""
    head = text.split("\n", 3)[:2]
    if any("AdaptiveSparkPlan isFinalPlan=true" in h for h in head):
        text = text.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return text


def _exchanges(plan):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", plan))


def test_all_windows_share_one_exchange(spark):
    df = click_log(spark, SF)
    out = W.add_ordinals(W.add_gaps(df, max_group_rows=None), max_group_rows=None)
    plan = _plan(out)
    assert len(re.findall(r"\bWindow \[", plan)) >= 12
    assert "ENSURE_REQUIREMENTS" not in plan  # only the repartitions by user


def test_small_group_sizes_need_no_shuffle(spark):
    # the sizes are counted before; what is left are broadcast joins
    plan = _plan(E.queries()["count_global"](spark, SF))
    assert _exchanges(plan) == 0 and "SortMergeJoin" not in plan


def test_user_groupings_share_one_exchange(spark):
    plan = _plan(E.queries()["count_user_cross"](spark, SF))
    assert _exchanges(plan) == 1 and "Join" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(E.queries()["vocab_topk"](spark, SF))
    assert "ReadSchema: struct<text:string>" in plan


def test_stage_filter_prunes_partitions(spark):
    df = click_log(spark, SF)
    path = scratch_path(spark, "plan-test")
    IO.write_stage(df.select("instance_id", "day"), path)
    _, hold = R.split_by_day(IO.read_stage(spark, path), 24)
    plan = _plan(hold.select("instance_id"))
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)


def test_filter_pushed_to_scan(spark):
    plan = _plan(E.queries()["row_anti_join"](spark, SF))
    assert "EqualTo(l_returnflag,R)" in plan


@pytest.mark.parametrize("name", ["rate_smoothed", "list_multi_hot", "enc_joint"])
def test_lookup_queries_do_not_shuffle_the_log(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "SortMergeJoin" not in plan and "ENSURE_REQUIREMENTS" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS", "")
