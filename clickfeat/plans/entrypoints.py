"""The reference's end-to-end flows as Spark jobs, built from the operators.

* ``stage_features``   - load/dedup, calendar + category columns, gaps and
  label histories in four scopes, written as a Parquet stage partitioned by
  ``day`` (the reference's first manual run).
* ``train_and_score``  - read the stage, add group sizes, multi-hot lists,
  prior-purchase flags, ordinals and jointly encoded histories, split by
  day, fit boosted trees, report log-loss and write predictions.
* ``export_ffm``       - list ranks, buckets, joint codes, the frequency
  table, field numbers, and field-aware text rows for train and holdout.
* ``blend_files``      - read prediction tables, blend them by key, write.

Column names follow the raw log schema (``clickfeat.schema.RAW_LOG``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickfeat.functions import lists as L
from clickfeat.operators import encode as EN
from clickfeat.operators import evaluate as EVL
from clickfeat.operators import ffm as FF
from clickfeat.operators import learn as ML
from clickfeat.operators import rates as RT
from clickfeat.operators import rows as R
from clickfeat.operators import vocab as V
from clickfeat.operators import windows as W
from clickfeat.plans import features as FT
from clickfeat.plans.base import add_time_and_category
from clickfeat.sources import logs as IO

HISTORIES = [s[2] for s in W.SCOPES.values()]


def prepare_log(train: DataFrame, test: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """Dedup by ``instance_id`` (first by time), drop train rows whose key is in
    test, union (test label -> 0), calendar and category columns."""
    order = ["context_timestamp"]
    train = R.dedup_first(train, ["instance_id"], order)
    if test is not None:
        test = R.dedup_first(test, ["instance_id"], order)
        train = R.anti_by_key(train, test, "instance_id")
        train = R.union_train_test(train, test, None)
    return add_time_and_category(R.fill_label(train), zone=zone)


def stage_features(log: DataFrame, stage_path: str, holdout_day: int = 24) -> None:
    """First phase: time/category columns are expected (``prepare_log``)."""
    IO.write_stage(W.add_gaps(log, mask_day=holdout_day), stage_path)


def train_and_score(spark: SparkSession, stage_path: str, out_path: str | None = None,
                    holdout_day: int = 24, max_iter: int = 50, max_depth: int = 5) -> DataFrame:
    """Second phase.  Returns ``part, log_loss, rows`` (train / holdout)."""
    stage = IO.read_stage(spark, stage_path)
    df = FT.full_features(stage.drop(*HISTORIES), holdout_day=holdout_day, with_gaps=False)  # joint history codes (D6)
    feats = FT.numeric_features(df)
    train, hold = R.split_by_day(df, holdout_day)
    model = ML.fit_gbt(train, feats, max_iter=max_iter, max_depth=max_depth)
    scored = ML.score(model, df, feats, keep=["day"])
    if out_path:
        IO.write_predictions(scored.where(F.col("day") == holdout_day), out_path)
    part = F.when(F.col("day") < holdout_day, "train").otherwise("holdout").alias("part")
    scored = scored.where(F.col("day") <= holdout_day)  # the days with labels
    return EVL.log_loss(scored.select("is_trade", "predicted_score", part), by=["part"])


NO_LIST = ["item_id", "item_brand_id", "item_city_id", "item_price_level", "item_sales_level",
           "item_collected_level", "item_pv_level", "user_id", "user_gender_id", "user_age_level",
           "user_occupation_id", "user_star_level", "context_page_id", "is_week", "hour", "shop_id",
           "shop_review_num_level", "shop_star_level", "category_1"]
BUCKETED = ["shop_review_positive_rate", "shop_score_service", "shop_score_delivery", "shop_score_description"]
LISTS = ["most_proerty", "most_predict_cat", "most_predict_pro"]


FFM_SCALARS = NO_LIST + [f"{c}_buck" for c in BUCKETED]


ORDER = ["context_timestamp", "instance_id"]


def ffm_raw(log: DataFrame, leaves: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The log with list ranks, buckets and the raw values of all scalar fields,
    and the scalar fields in order; written once, as it is read for the values
    and for the rows.  ``leaves`` (``instance_id``, one column per tree) adds the
    tree-leaf fields, joined by key."""
    log = R.replace_sentinel(log, "shop_review_positive_rate", -1, 0.0)
    props = L.tokens("item_property_list")
    pcat = L.predict_categories("predict_category_property")
    ppro = L.predict_properties("predict_category_property")
    voc = V.vocabularies(log, {"p": (props, 1000, False), "c": (pcat, 30, False), "r": (ppro, 25, False)})
    df = log.select("*", V.overlap_ranks(props, voc["p"]).alias("most_proerty"),
                    V.overlap_ranks(pcat, voc["c"]).alias("most_predict_cat"),
                    V.overlap_ranks(ppro, voc["r"]).alias("most_predict_pro"))
    df = EN.equal_width_bins(df, BUCKETED, 10, "_buck")
    scalars = list(FFM_SCALARS)
    if leaves is not None:
        own = [c for c in leaves.columns if c != "instance_id"]
        df, scalars = df.join(leaves, "instance_id", "left"), scalars + own
    return EN.staged(df.select("instance_id", "is_trade", "day", "context_timestamp", *LISTS, *scalars), "ffm-raw", wide=True), scalars


def ffm_frame(log: DataFrame, leaves: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """``ffm_raw`` with joint codes of all scalar fields."""
    df, scalars = ffm_raw(log, leaves)
    return EN.first_seen_codes(df, scalars, ORDER), scalars


def ffm_table(log: DataFrame, leaves: DataFrame | None = None, min_total: int = 10) -> DataFrame:
    """The Field/Value frequency table of the coded fields and the list ranks."""
    df, scalars = ffm_raw(log, leaves)
    return RT.coded_value_table(EN.value_table(df, scalars, ORDER, "is_trade"), df, scalars, LISTS, min_total=min_total)


def export_ffm(log: DataFrame, out_dir: str, holdout_day: int = 24, min_total: int = 10,
               leaves: DataFrame | None = None) -> DataFrame:
    """Field-aware rows for train (``tr``) and holdout (``va``); returns the
    Field/Value frequency table (also written as ``count_frequent_feature``)."""
    raw, scalars = ffm_raw(log, leaves)
    values = EN.value_table(raw, scalars, ORDER, "is_trade")
    table = EN.staged(RT.coded_value_table(values, raw, scalars, LISTS, min_total=min_total), "frequency-table")  # read more than once
    IO.write_freq_table(table, f"{out_dir}/count_frequent_feature")
    df = EN.first_seen_codes(raw, scalars, ORDER, values=values)
    train, hold = R.split_by_day(df, holdout_day)
    FF.write_ffm(FF.ffm_rows(train, "is_trade", LISTS, scalars), f"{out_dir}/tr")
    FF.write_ffm(FF.ffm_rows(hold, "is_trade", LISTS, scalars), f"{out_dir}/va")
    return table


def export_ffm_online(log: DataFrame, out_dir: str, test_day: int = 25, min_total: int = 10, top: int = 100,
                      leaves: DataFrame | None = None) -> DataFrame:
    """The online export: all labelled days (``tr``) and the test day (``ve``).  Behind
    the list and scalar fields come the frequent and the high-ratio
    ``Field-Value`` features, whose numbers depend on data (``ffm.feature_dictionary``),
    and then the leaf fields.  Returns the dictionary."""
    raw, scalars = ffm_raw(log, leaves)
    values = EN.value_table(raw, scalars, ORDER, "is_trade")
    own = scalars[len(FFM_SCALARS):]
    table = EN.staged(RT.coded_value_table(values, raw, scalars, LISTS, min_total=min_total), "frequency-table")  # read more than once
    IO.write_freq_table(table, f"{out_dir}/count_frequent_feature")
    first = len(LISTS) + len(FFM_SCALARS)
    dictionary, n = FF.feature_dictionary(table.where(~F.col("Field").isin(own) if own else F.lit(True)), first, top, min_total)
    df = EN.staged(EN.first_seen_codes(raw, scalars, ORDER, values=values), "ffm-coded", wide=True)
    df = FF.with_dictionary_fields(df, dictionary, LISTS, FFM_SCALARS)
    rows = FF.ffm_rows_online(df, "is_trade", LISTS, FFM_SCALARS, first + n, own)
    rows = EN.staged(rows, "ffm-online")
    FF.write_ffm(rows.where(F.col("day") < test_day), f"{out_dir}/tr")
    FF.write_ffm(rows.where(F.col("day") == test_day), f"{out_dir}/ve")
    return dictionary


def blend_files(spark: SparkSession, inputs: list[tuple[str, float]], out_path: str) -> DataFrame:
    """Weighted blend of prediction files joined on ``instance_id``."""
    tables = [(IO.read_predictions(spark, p), w) for p, w in inputs]
    out = EVL.blend(tables)
    IO.write_predictions(out, out_path)
    return out
