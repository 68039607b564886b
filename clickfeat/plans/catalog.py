"""The query catalogue: one Spark plan per operator of the reference, each
with an independent DuckDB oracle (``clickfeat.plans.oracle_base`` CTEs).

Every query reads the shared tables (or frames Spark derives from them),
runs over all their rows, and aliases every output column to the name the
oracle uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickfeat.operators import counts as C
from clickfeat.operators import windows as W
from clickfeat.plans.base import click_log
from clickfeat.plans.oracle_base import EVENTS_LOG, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EV = with_ctes(EVENTS_LOG)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _in(cols):
    return ", ".join(cols)


# ---------------------------------------------------------------- time
@register("time_parts", EV + """
SELECT instance_id, time, is_week, day, hour, minute FROM flog""")
def q_time_parts(spark, sf):
    return click_log(spark, sf).select("instance_id", "time", "is_week", "day", "hour", "minute")


@register("time_half_hour", EV + """
SELECT instance_id, half_hour,
       CAST(dense_rank() OVER (ORDER BY first_seen) AS BIGINT) AS half_hour_code
FROM (SELECT instance_id, half_hour,
             min(context_timestamp * 1000000000 + instance_id) OVER (PARTITION BY half_hour) AS first_seen
      FROM flog)""")
def q_time_half_hour(spark, sf):
    from clickfeat.operators.encode import first_seen_codes
    df = click_log(spark, sf)
    return first_seen_codes(df, ["half_hour"], order=["context_timestamp", "instance_id"],
                            suffix="_code").select("instance_id", "half_hour", "half_hour_code")


# ------------------------------------------------------- gaps / history
def _gap_sql(keys, prefix):
    return EV + f"""
SELECT instance_id,
  CAST(abs(context_timestamp - lag(context_timestamp) OVER w) AS DOUBLE) / 60 AS {prefix}diff_1,
  CAST(abs(context_timestamp - lead(context_timestamp) OVER w) AS DOUBLE) / 60 AS {prefix}diff_2,
  CAST(max(context_timestamp) OVER g - context_timestamp AS DOUBLE) / 60 AS {prefix}diff_3,
  CAST(context_timestamp - min(context_timestamp) OVER g AS DOUBLE) / 60 AS {prefix}diff_4
FROM flog
WINDOW w AS (PARTITION BY {_in(keys)} ORDER BY context_timestamp, instance_id),
       g AS (PARTITION BY {_in(keys)})"""


def _hist_sql(keys, name, mask_day=24):
    return EV + f"""
SELECT instance_id,
  coalesce(string_agg(CASE WHEN day < {mask_day} THEN CAST(is_trade AS VARCHAR) ELSE '0' END, ''
                      ORDER BY context_timestamp, instance_id)
           OVER (PARTITION BY {_in(keys)} ORDER BY context_timestamp, instance_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS {name}
FROM flog"""


def _make_gap(scope):
    keys, prefix, hist = W.SCOPES[scope]

    def q(spark, sf):
        df = click_log(spark, sf).select("instance_id", "context_timestamp", *keys)
        out = W.add_gaps(df, scopes=(scope,), with_history=False)
        return out.select("instance_id", *[f"{prefix}diff_{i}" for i in range(1, 5)])

    def h(spark, sf):
        return W.add_history(click_log(spark, sf), (scope,)).select("instance_id", hist)

    register(f"gap_{scope}", _gap_sql(keys, prefix))(q)
    register(f"history_{scope}", _hist_sql(keys, hist))(h)


for _s in W.SCOPES:
    _make_gap(_s)


@register("label_mask", EV + """
SELECT instance_id, CASE WHEN day < 24 THEN CAST(is_trade AS VARCHAR) ELSE '0' END AS new_trade FROM flog""")
def q_label_mask(spark, sf):
    return click_log(spark, sf).select("instance_id", W.label_mask().alias("new_trade"))


# ------------------------------------------------------- ordinals
def _ordinal_sql():
    cols = []
    for name, keys in W.ORDINALS.items():
        w = f"(PARTITION BY {_in(keys)} ORDER BY context_timestamp, instance_id)"
        cols.append(f"CAST(row_number() OVER {w} AS BIGINT) AS {name}")
    return cols


@register("ordinal_click", EV + "\nSELECT instance_id, " + ",\n ".join(_ordinal_sql()) + "\nFROM flog")
def q_ordinal_click(spark, sf):
    df = W.add_ordinals(click_log(spark, sf))
    return df.select("instance_id", *W.ORDINALS)


def _first_last_sql():
    cols = []
    for name, keys in W.ORDINALS.items():
        if not name.endswith("_day"):
            continue
        base = name[:-4]
        w = f"(PARTITION BY {_in(keys)} ORDER BY context_timestamp, instance_id)"
        cols.append(f"CAST(row_number() OVER {w} = 1 AS INTEGER) AS {base}_first_day")
        cols.append(f"CAST(row_number() OVER {w} = count(*) OVER (PARTITION BY {_in(keys)}) AS INTEGER)"
                    f" AS {base}_last_day")
    return cols


@register("ordinal_first_last", EV + "\nSELECT instance_id, " + ",\n ".join(_first_last_sql()) + "\nFROM flog")
def q_ordinal_first_last(spark, sf):
    df = W.add_ordinals(click_log(spark, sf))
    return df.select("instance_id", *[c for c in df.columns if c.endswith("_first_day") or c.endswith("_last_day")])


# ------------------------------------------------------- group sizes
def _count_sql(groups, where=""):
    cols = [f"CAST(count(*) OVER (PARTITION BY {_in(ks)}) AS BIGINT) AS {g}" for g, ks in groups.items()]
    return EV + "\nSELECT instance_id, " + ",\n ".join(cols) + "\nFROM flog" + (f" WHERE {where}" if where else "")


def _make_count(name, groups):
    def q(spark, sf):
        df = click_log(spark, sf)
        return C.add_group_sizes(df, groups).select("instance_id", *groups)
    register(name, _count_sql(groups))(q)


_make_count("count_global", C.GLOBAL_COUNTS)
_make_count("count_user_cross", C.USER_CROSS_COUNTS)
_make_count("count_user_day", {**C.USER_DAY_COUNTS, **C.USER_DAY_EXTRA_COUNTS})
_make_count("count_user_hour", C.USER_HOUR_COUNTS)
_make_count("count_user_half_hour", C.USER_HALF_HOUR_COUNTS)
_make_count("count_user_query", C.USER_QUERY_COUNTS)


# ------------------------------------------------------- row hygiene (P, U, J4)
from clickfeat.operators import rows as R  # noqa: E402
from clickfeat.operators import prior as PR  # noqa: E402
from clickfeat.operators import rates as RT  # noqa: E402
from clickfeat.operators import profile as PF  # noqa: E402
from clickfeat.sources.standin import table  # noqa: E402

_LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]


@register("row_dedup_key", """
SELECT l_orderkey, l_linenumber, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS l_shipdate, l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_discount
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                            l_discount, l_tax, l_returnflag, l_linestatus) AS rn
      FROM lineitem) WHERE rn = 1""")
def q_row_dedup_key(spark, sf):
    li = table(spark, sf, "lineitem")
    d = R.dedup_first(li, ["l_orderkey", "l_linenumber"], _LI_ORDER)
    # timestamps leave as epoch seconds: one representation for every engine
    return d.select("l_orderkey", "l_linenumber", F.unix_timestamp("l_shipdate").alias("l_shipdate"),
                    *_LI_ORDER[1:])


@register("row_distinct", EV + """
SELECT DISTINCT user_id, item_id, day, is_trade FROM flog""")
def q_row_distinct(spark, sf):
    return R.distinct_rows(click_log(spark, sf).select("user_id", "item_id", "day", "is_trade"))


@register("split_by_day", EV + """
SELECT instance_id, day, CASE WHEN day < 24 THEN 'train' ELSE 'holdout' END AS part
FROM flog WHERE day <= 24""")
def q_split_by_day(spark, sf):
    return R.tag_split(click_log(spark, sf), 24).select("instance_id", "day", "part")


_EXCLUDED = [3, 17, 256, 1024, 4096, 9999, 31337]


@register("row_exclude_ids", EV + f"""
SELECT instance_id, user_id FROM flog WHERE instance_id NOT IN ({", ".join(map(str, _EXCLUDED))})""")
def q_row_exclude_ids(spark, sf):
    return R.exclude_ids(click_log(spark, sf), _EXCLUDED).select("instance_id", "user_id")


@register("row_anti_join", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def q_row_anti_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    ret = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.anti_by_key(o, ret, "o_orderkey")


_DOC_LABELS = """
dl AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _doc_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


@register("split_by_label_null", with_ctes(_DOC_LABELS) + """
SELECT doc_id, CASE WHEN quality IS NULL THEN 'unlabelled' ELSE 'labelled' END AS part FROM dl""")
def q_split_by_label_null(spark, sf):
    lab, unl = R.split_by_label_null(_doc_labels(spark, sf), "quality")
    return (lab.select("doc_id", F.lit("labelled").alias("part"))
               .unionByName(unl.select("doc_id", F.lit("unlabelled").alias("part"))))


@register("fill_label", with_ctes(_DOC_LABELS) + """
SELECT doc_id, CAST(coalesce(quality, 0) AS INTEGER) AS quality FROM dl""")
def q_fill_label(spark, sf):
    return R.fill_label(_doc_labels(spark, sf), "quality").select("doc_id", "quality")


@register("fill_sentinel", with_ctes(_DOC_LABELS) + """
SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM dl""")
def q_fill_sentinel(spark, sf):
    return R.fill_sentinel(_doc_labels(spark, sf), -1).select("doc_id", "quality", "toxic")


@register("replace_sentinel", EV + """
SELECT instance_id, CASE WHEN shop_review_positive_rate = -1 THEN 0.0 ELSE shop_review_positive_rate END
       AS shop_review_positive_rate FROM flog""")
def q_replace_sentinel(spark, sf):
    return R.replace_sentinel(click_log(spark, sf), "shop_review_positive_rate", -1, 0.0).select(
        "instance_id", "shop_review_positive_rate")


_NOT_FEATURES = ["instance_id", "user_id", "time", "context_timestamp", "context_id", "item_category_list", "item_property_list",
                 "predict_category_property", "minute", "is_trade"]


@register("feature_columns", EV + """
SELECT * EXCLUDE (instance_id, user_id, time, context_timestamp, context_id, item_category_list, item_property_list,
                  predict_category_property, minute, is_trade) FROM flog""")
def q_feature_columns(spark, sf):
    df = click_log(spark, sf)
    return df.select(*R.feature_columns(df, _NOT_FEATURES))


@register("union_train_test", EV + """
SELECT instance_id, 'train' AS src, is_trade FROM flog WHERE day < 25
UNION ALL
SELECT instance_id, 'test' AS src, NULL AS is_trade FROM flog WHERE day >= 25""")
def q_union_train_test(spark, sf):
    df = click_log(spark, sf)
    train = df.where("day < 25").select("instance_id", "is_trade")
    test = df.where("day >= 25").select("instance_id")
    return R.union_train_test(train, test, "src").select("instance_id", "src", "is_trade")


# ------------------------------------------------------- prior trades
def _prior_sql(pair, show, flag):
    on = " AND ".join(f"a.{k} = s.{k}" for k in pair)
    return EV + f""",
st AS (SELECT {_in(pair)}, count(*) AS n,
              max(CASE WHEN is_trade = 1 THEN context_timestamp END) AS tt
       FROM flog WHERE day < 24 GROUP BY {_in(pair)})
SELECT a.instance_id, CAST(s.n AS BIGINT) AS {show},
       CASE WHEN s.tt IS NULL OR a.context_timestamp <= s.tt THEN 1 ELSE 0 END AS {flag}
FROM flog a LEFT JOIN st s ON {on}"""


def _prior_strict_sql(pair, show, flag):
    w = (f"(PARTITION BY {_in(pair)} ORDER BY context_timestamp, instance_id "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return EV + f"""
SELECT instance_id, CAST(nullif(count(*) FILTER (WHERE day < 24) OVER {w}, 0) AS BIGINT) AS {show},
       CASE WHEN coalesce(sum(CASE WHEN day < 24 THEN is_trade END) OVER {w}, 0) > 0 THEN 0 ELSE 1 END AS {flag}
FROM flog"""


def _make_prior(name):
    pair, show, flag = PR.PRIOR_PAIRS[name]

    def q(spark, sf):
        df = click_log(spark, sf)
        return PR.prior_trade(df, df.where("day < 24"), pair, show, flag).select("instance_id", show, flag)

    def strict(spark, sf):
        df = click_log(spark, sf)
        return PR.prior_trade(df, df.where("day < 24"), pair, show, flag, strict=True).select("instance_id", show, flag)
    register(f"prior_trade_{name}", _prior_sql(pair, show, flag))(q)
    register(f"prior_trade_strict_{name}", _prior_strict_sql(pair, show, flag))(strict)


for _p in PR.PRIOR_PAIRS:
    _make_prior(_p)


# ------------------------------------------------------- smoothed rates
def _rate_sql():
    ctes, cols, joins = [], [], []
    for i, (k, stem) in enumerate(RT.RATE_KEYS.items()):
        ctes.append(f"""r{i} AS (SELECT {k}, count(*) AS n, sum(CASE WHEN is_trade = 1 THEN 1 END) AS t
        FROM flog WHERE day < 24 AND {k} IS NOT NULL GROUP BY {k})""")
        cols += [f"CAST(r{i}.n AS BIGINT) AS {stem}_count", f"CAST(r{i}.t AS BIGINT) AS trade_{stem}_count",
                 f"r{i}.t / (r{i}.n + 10.0) AS {stem}_ctr"]
        joins.append(f"LEFT JOIN r{i} ON a.{k} = r{i}.{k}")
    return (EV + ",\n" + ",\n".join(ctes) + "\nSELECT a.instance_id, " + ", ".join(cols)
            + "\nFROM flog a " + "\n".join(joins))


@register("rate_smoothed", _rate_sql())
def q_rate_smoothed(spark, sf):
    df = click_log(spark, sf)
    out = RT.add_smoothed_rates(df, df.where("day < 24"))
    cols = [c for s in RT.RATE_KEYS.values() for c in (f"{s}_count", f"trade_{s}_count", f"{s}_ctr")]
    return out.select("instance_id", *cols)


_STRICT = {"item_id": "item", "shop_id": "shop", "category_1": "cat_1"}


def _strict_sql():
    cols = []
    for key, stem in _STRICT.items():
        w = f"(PARTITION BY {key} ORDER BY context_timestamp RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        n, t = f"CAST(count(*) OVER {w} AS BIGINT)", f"CAST(coalesce(sum(is_trade) OVER {w}, 0) AS BIGINT)"
        cols += [f"{n} AS {stem}_before", f"{t} AS trade_{stem}_before", f"{t} / ({n} + 10.0) AS {stem}_strict_ctr"]
    return EV + "\nSELECT instance_id, " + ",\n ".join(cols) + "\nFROM flog"


@register("rate_strict", _strict_sql())
def q_rate_strict(spark, sf):
    out = RT.add_strict_rates(click_log(spark, sf), _STRICT)
    return out.select("instance_id", *[c for s in _STRICT.values() for c in (f"{s}_before", f"trade_{s}_before", f"{s}_strict_ctr")])


# ------------------------------------------------------- frequency table
from clickfeat.plans import entrypoints as EP  # noqa: E402


def _first_seen_sql(src, col, name):
    return f"""SELECT {col} AS v, CAST(row_number() OVER (ORDER BY context_timestamp, instance_id) AS BIGINT) AS {name}
FROM (SELECT {col}, context_timestamp, instance_id,
             row_number() OVER (PARTITION BY {col} ORDER BY context_timestamp, instance_id) AS r FROM {src})
WHERE r = 1"""


def _bins_sql(cols, suffix):
    """``b1``: the log with equal-width bins of the rate and score columns."""
    mm = "mm AS (SELECT " + ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols) + " FROM b0)"
    bins = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL WHEN mx_{c} = mn_{c} THEN 4 ELSE CAST(least(greatest("
        f"ceil(({c} - mn_{c}) / ((mx_{c} - mn_{c}) / 10.0)) - 1, 0), 9) AS INTEGER) END AS {c}{suffix}"
        for c in cols)
    return f"""b0 AS (SELECT * REPLACE (CASE WHEN shop_review_positive_rate = -1 THEN 0.0 ELSE shop_review_positive_rate END
                  AS shop_review_positive_rate) FROM flog),
{mm},
b1 AS MATERIALIZED (SELECT b0.*, {bins} FROM b0, mm)"""


def _codes_sql(src, cols, keep, name):
    """CTE ``name``: the columns ``keep`` of ``src`` and the codes of ``cols``."""
    ctes = [f"{name}_{i} AS ({_first_seen_sql(src, c, 'code')})" for i, c in enumerate(cols)]
    joins = " ".join(f"JOIN {name}_{i} ON a.{c} IS NOT DISTINCT FROM {name}_{i}.v" for i, c in enumerate(cols))
    out = ", ".join([f"a.{c}" for c in keep] + [f"{name}_{i}.code AS {c}" for i, c in enumerate(cols)])
    return ",\n".join([*ctes, f"{name} AS MATERIALIZED (SELECT {out} FROM {src} a {joins})"])


def _topk_cte(name, tokens_sql, k, more=""):
    return f"""{name} AS (SELECT token, {more and more + ", "}row_number() OVER (ORDER BY cnt DESC, token) - 1 AS rnk FROM (
  SELECT token, count(*) AS cnt FROM ({tokens_sql}) GROUP BY token ORDER BY cnt DESC, token LIMIT {k}))"""


_PCAT = """list_transform(list_filter(string_split(predict_category_property, ';'), lambda t: len(string_split(t, ':')) > 1),
                      lambda t: string_split(t, ':')[1])"""
_PPRO = """flatten(list_transform(list_filter(string_split(predict_category_property, ';'), lambda t: len(string_split(t, ':')) > 1),
    lambda t: CASE WHEN string_split(t, ':')[2] = '-1' THEN []::VARCHAR[] ELSE string_split(string_split(t, ':')[2], ',') END))"""


def _ffm_ctes():
    """``enc`` (codes of all scalar fields) and ``rk`` (ranks of the list tokens)."""
    lists = ["string_split(item_property_list, ';')", _PCAT, _PPRO]
    vocabs = [_topk_cte(f"v{i}", f"SELECT unnest({x}) AS token FROM flog", k) for i, (x, k) in enumerate(zip(lists, (1000, 30, 25)))]
    toks = "\n  UNION ALL ".join(f"SELECT instance_id, is_trade, {i} AS f, unnest(list_distinct({x})) AS tok FROM flog" for i, x in enumerate(lists))
    ranks = "\n  UNION ALL ".join(f"SELECT instance_id, is_trade, f, rnk FROM tk JOIN v{i} ON f = {i} AND tok = v{i}.token" for i in range(3))
    return (EV + ",\n" + _bins_sql(EP.BUCKETED, "_buck") + ",\n"
            + _codes_sql("b1", EP.FFM_SCALARS, ["instance_id", "is_trade", "day"], "enc") + ",\n" + ",\n".join(vocabs)
            + f",\ntk AS ({toks}),\nrk AS ({ranks})")


def _freq_table(spark, sf):
    return EP.ffm_table(click_log(spark, sf))


def _freq_sql():
    parts = [f"SELECT '{c}' AS Field, CAST({c} AS VARCHAR) AS Value, is_trade AS y FROM enc" for c in EP.FFM_SCALARS]
    parts += [f"SELECT '{c}', CAST(rnk AS VARCHAR), is_trade FROM rk WHERE f = {i}" for i, c in enumerate(EP.LISTS)]
    return _ffm_ctes() + ",\nlong AS (" + "\nUNION ALL\n".join(parts) + """),
ft AS (SELECT Field, Value, CAST(sum(1 - y) AS BIGINT) AS Neg, CAST(sum(y) AS BIGINT) AS Pos,
              CAST(count(*) AS BIGINT) AS Total
       FROM long GROUP BY Field, Value)
"""


@register("freq_feature_stats", _freq_sql() + """
SELECT Field, Value, Neg, Pos, Total, round(Pos / Total, 5) AS Ratio FROM ft WHERE Total >= 10""")
def q_freq_feature_stats(spark, sf):
    t = _freq_table(spark, sf)
    return t.orderBy("Total", "Field", "Value")


@register("freq_frequent", _freq_sql() + """
SELECT Field || '-' || Value AS feature, Total, round(Pos / Total, 5) AS Ratio FROM ft WHERE Total >= 10""")
def q_freq_frequent(spark, sf):
    t = _freq_table(spark, sf)
    return RT.frequent_features(t, 10)


@register("freq_high_ratio", _freq_sql() + """
SELECT Field || '-' || Value AS feature, Total, round(Pos / Total, 5) AS Ratio FROM ft WHERE Total >= 10
ORDER BY Ratio DESC, feature LIMIT 100""")
def q_freq_high_ratio(spark, sf):
    t = _freq_table(spark, sf)
    return RT.high_ratio_features(t, 100, 10)


# ------------------------------------------------------- profile
_PROFILE_COLS = ["item_id", "user_id", "shop_id", "item_brand_id", "item_city_id", "category_1", "context_page_id",
                 "user_gender_id", "user_age_level", "user_occupation_id", "user_star_level", "hour", "day"]


@register("profile_distinct", EV + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS field, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM flog" for c in _PROFILE_COLS))
def q_profile_distinct(spark, sf):
    return PF.distinct_counts(click_log(spark, sf), _PROFILE_COLS)


@register("profile_daily_cvr", EV + """
SELECT day, CAST(count(*) AS BIGINT) AS rows, CAST(sum(is_trade) AS BIGINT) AS trades,
       round(avg(CAST(is_trade AS DOUBLE)), 6) AS cvr FROM flog GROUP BY day""")
def q_profile_daily_cvr(spark, sf):
    return PF.daily_cvr(click_log(spark, sf))


@register("profile_user_overlap", EV + """
SELECT CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE user_id IN (SELECT user_id FROM flog WHERE day < 24)) AS BIGINT) AS overlap_rows,
       round(count(*) FILTER (WHERE user_id IN (SELECT user_id FROM flog WHERE day < 24)) / count(*), 6) AS share
FROM flog WHERE day = 24""")
def q_profile_user_overlap(spark, sf):
    df = click_log(spark, sf)
    train, hold = R.split_by_day(df, 24)
    return PF.user_overlap(train, hold)


# ------------------------------------------------------- lists (A1-A4)
from clickfeat.functions import lists as L  # noqa: E402
from clickfeat.operators import vocab as V  # noqa: E402
from clickfeat.operators import encode as EN  # noqa: E402
from clickfeat.plans.oracle_base import CATEGORY_PATHS, ORDER_LOG, PREDICT_STRINGS  # noqa: E402
from clickfeat.sources.standin import category_paths, order_log, predict_strings  # noqa: E402


@register("list_category_levels", with_ctes(CATEGORY_PATHS) + """
SELECT row_id,
       TRY_CAST(coalesce(string_split(item_category_list, ';')[1], '-1') AS BIGINT) AS category_0,
       TRY_CAST(coalesce(string_split(item_category_list, ';')[2], '-1') AS BIGINT) AS category_1,
       TRY_CAST(coalesce(string_split(item_category_list, ';')[3], '-1') AS BIGINT) AS category_2
FROM cpath""")
def q_list_category_levels(spark, sf):
    df = category_paths(spark, sf)
    return df.select("row_id", *[L.category_level("item_category_list", i).alias(f"category_{i}") for i in range(3)])


@register("list_predicted_category", EV + """
SELECT instance_id,
       TRY_CAST(coalesce(split_part(string_split(predict_category_property, ';')[1], ':', 1), '-1') AS BIGINT)
         AS predict_category_0,
       TRY_CAST(coalesce(split_part(string_split(predict_category_property, ';')[2], ':', 1), '-1') AS BIGINT)
         AS predict_category_1,
       TRY_CAST(coalesce(split_part(string_split(predict_category_property, ';')[3], ':', 1), '-1') AS BIGINT)
         AS predict_category_2
FROM flog""")
def q_list_predicted_category(spark, sf):
    df = click_log(spark, sf)
    return df.select("instance_id", *[L.predicted_category("predict_category_property", i)
                                      .alias(f"predict_category_{i}") for i in range(3)])


_PARSE_SQL = """
SELECT row_id,
       array_to_string(list_transform(ok, lambda t: string_split(t, ':')[1]), ';') AS cats,
       array_to_string(flatten(list_transform(ok, lambda t: CASE WHEN string_split(t, ':')[2] = '-1'
                                                            THEN []::VARCHAR[]
                                                            ELSE string_split(string_split(t, ':')[2], ',') END)),
                       ',') AS props,
       CAST(len(ok) AS BIGINT) AS n_cats,
       CAST(len(flatten(list_transform(ok, lambda t: CASE WHEN string_split(t, ':')[2] = '-1'
                                                     THEN []::VARCHAR[]
                                                     ELSE string_split(string_split(t, ':')[2], ',') END))) AS BIGINT)
         AS n_props
FROM (SELECT row_id, list_filter(string_split(predict_category_property, ';'),
                                 lambda t: len(string_split(t, ':')) > 1) AS ok FROM pstr)"""


@register("list_predict_parse", with_ctes(PREDICT_STRINGS) + _PARSE_SQL)
def q_list_predict_parse(spark, sf):
    df = predict_strings(spark, sf)
    cats = L.predict_categories("predict_category_property")
    props = L.predict_properties("predict_category_property")
    return df.select("row_id", F.array_join(cats, ";").alias("cats"), F.array_join(props, ",").alias("props"),
                     F.size(cats).cast("bigint").alias("n_cats"), F.size(props).cast("bigint").alias("n_props"))


@register("list_property_num", EV + """
SELECT instance_id, CAST(len(string_split(item_property_list, ';')) AS BIGINT) AS item_property_num FROM flog""")
def q_list_property_num(spark, sf):
    df = click_log(spark, sf)
    return df.select("instance_id", L.property_count("item_property_list").cast("bigint").alias("item_property_num"))


# ------------------------------------------------------- vocabularies (V1-V4)
@register("vocab_topk_positive", with_ctes(ORDER_LOG) + """
SELECT token, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT unnest(string_split(item_property_list, ';')) AS token FROM olog WHERE is_trade = 1)
GROUP BY token ORDER BY cnt DESC, token LIMIT 10""")
def q_vocab_topk_positive(spark, sf):
    df = order_log(spark, sf)
    return V.topk_tokens(df, L.tokens("item_property_list"), 10, positives_only=True)


@register("vocab_topk", """
SELECT token, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
GROUP BY token ORDER BY cnt DESC, token LIMIT 100""")
def q_vocab_topk(spark, sf):
    docs = table(spark, sf, "documents").select("text")
    return V.topk_tokens(docs.withColumn("is_trade", F.lit(0)), L.tokens("text", " "), 100)


@register("vocab_topk_predict", EV + """
SELECT * FROM (
  SELECT 'cat' AS kind, token, CAST(count(*) AS BIGINT) AS cnt
  FROM (SELECT string_split(t, ':')[1] AS token
        FROM (SELECT unnest(string_split(predict_category_property, ';')) AS t FROM flog)
        WHERE len(string_split(t, ':')) > 1)
  GROUP BY token ORDER BY cnt DESC, token LIMIT 30)
UNION ALL
SELECT * FROM (
  SELECT 'pro' AS kind, token, CAST(count(*) AS BIGINT) AS cnt
  FROM (SELECT unnest(string_split(string_split(t, ':')[2], ',')) AS token
        FROM (SELECT unnest(string_split(predict_category_property, ';')) AS t FROM flog)
        WHERE len(string_split(t, ':')) > 1 AND string_split(t, ':')[2] <> '-1')
  GROUP BY token ORDER BY cnt DESC, token LIMIT 25)""")
def q_vocab_topk_predict(spark, sf):
    df = click_log(spark, sf)
    c = V.topk_tokens(df, L.predict_categories("predict_category_property"), 30)
    p = V.topk_tokens(df, L.predict_properties("predict_category_property"), 25)
    return (c.select(F.lit("cat").alias("kind"), "token", "cnt")
             .unionByName(p.select(F.lit("pro").alias("kind"), "token", "cnt")))


def _heavy_sql():
    where = {"q": ("string_split(item_property_list, ';')", 10, "WHERE is_trade = 1"), "a": ("string_split(item_property_list, ';')", 1000, ""),
             "c": (_PCAT, 30, ""), "r": (_PPRO, 25, "")}
    vocabs = [_topk_cte(f"t_{v}", f"SELECT unnest({x}) AS token, is_trade FROM flog {w}", k, "cnt") for v, (x, k, w) in where.items()]
    vocabs.append(_topk_cte("t_text", "SELECT unnest(string_split(text, ' ')) AS token FROM documents", 100, "cnt"))
    return EV + ",\n" + ",\n".join(vocabs) + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{v}' AS v, token, cnt, rnk, TRUE AS certain FROM t_{v}" for v in [*where, "text"])


@register("vocab_heavy", _heavy_sql())
def q_vocab_heavy(spark, sf):
    """The top-k of the log's lists and of the documents' words by sketch and certificate."""
    log = click_log(spark, sf)
    props, cats, pros = L.tokens("item_property_list"), L.predict_categories("predict_category_property"), L.predict_properties("predict_category_property")
    out = V.heavy_tokens(log, {"q": (props, 10, True), "a": (props, 1000, False), "c": (cats, 30, False), "r": (pros, 25, False)})
    docs = table(spark, sf, "documents").select("text")
    words = V.heavy_tokens(docs, {"text": (L.tokens("text", " "), 100, False)})
    return out.unionByName(words).select("v", "token", "cnt", "rnk", (F.col("cnt") >= F.col("others_below")).alias("certain"))


# ------------------------------------------------------- membership
def _vocab_cte(name, k, positives=False):
    where = "WHERE is_trade = 1 AND day < 24" if positives else "WHERE day < 24"
    return f"""{name} AS (
  SELECT token, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS rnk FROM (
    SELECT token, count(*) AS cnt
    FROM (SELECT unnest(string_split(item_property_list, ';')) AS token FROM flog {where})
    GROUP BY token ORDER BY cnt DESC, token LIMIT {k}))"""


@register("list_vocab_overlap", EV + ",\n" + _vocab_cte("va", 100) + ",\n" + _vocab_cte("vp", 100, True) + """,
toks AS (SELECT instance_id, list_distinct(string_split(item_property_list, ';')) AS t FROM flog)
SELECT instance_id,
  CAST(len(list_intersect(t, (SELECT list(token) FROM va))) AS BIGINT) AS most_property_num,
  array_to_string(list_sort(list_intersect(t, (SELECT list(token) FROM va))), ';') AS most_property,
  CAST(len(list_intersect(t, (SELECT list(token) FROM vp))) AS BIGINT) AS trade_most_property_num,
  array_to_string(list_sort(list_intersect(t, (SELECT list(token) FROM vp))), ';') AS trade_most_property
FROM toks""")
def q_list_vocab_overlap(spark, sf):
    df = click_log(spark, sf)
    train = df.where("day < 24")
    tok = L.tokens("item_property_list")
    va = V.vocabulary(V.topk_tokens(train, tok, 100))
    vp = V.vocabulary(V.topk_tokens(train, tok, 100, positives_only=True))
    return df.select("instance_id",
                     V.overlap_count(tok, va).cast("bigint").alias("most_property_num"),
                     V.overlap_string(tok, va).alias("most_property"),
                     V.overlap_count(tok, vp).cast("bigint").alias("trade_most_property_num"),
                     V.overlap_string(tok, vp).alias("trade_most_property"))


@register("list_vocab_ranks", EV + ",\n" + _vocab_cte("va", 1000) + """,
x AS (SELECT instance_id, unnest(list_distinct(string_split(item_property_list, ';'))) AS tok FROM flog),
y AS (SELECT x.instance_id, string_agg(CAST(va.rnk AS VARCHAR), ',' ORDER BY va.rnk) AS s
      FROM x JOIN va ON x.tok = va.token GROUP BY x.instance_id)
SELECT f.instance_id, coalesce(y.s, '') AS most_proerty FROM flog f LEFT JOIN y ON f.instance_id = y.instance_id""")
def q_list_vocab_ranks(spark, sf):
    df = click_log(spark, sf)
    tok = L.tokens("item_property_list")
    va = V.vocabulary(V.topk_tokens(df.where("day < 24"), tok, 1000))
    return df.select("instance_id", F.array_join(V.overlap_ranks(tok, va), ",").alias("most_proerty"))


def _multi_hot_sql():
    cats = """pc AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS rnk FROM (
  SELECT token, count(*) AS cnt FROM (SELECT string_split(t, ':')[1] AS token
    FROM (SELECT unnest(string_split(predict_category_property, ';')) AS t FROM flog WHERE day < 24)
    WHERE len(string_split(t, ':')) > 1) GROUP BY token ORDER BY cnt DESC, token LIMIT 30))"""
    pros = """pp AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS rnk FROM (
  SELECT token, count(*) AS cnt FROM (SELECT unnest(string_split(string_split(t, ':')[2], ',')) AS token
    FROM (SELECT unnest(string_split(predict_category_property, ';')) AS t FROM flog WHERE day < 24)
    WHERE len(string_split(t, ':')) > 1 AND string_split(t, ':')[2] <> '-1')
  GROUP BY token ORDER BY cnt DESC, token LIMIT 25))"""
    parsed = """pl AS (SELECT instance_id, string_split(item_property_list, ';') AS props,
  list_transform(list_filter(string_split(predict_category_property, ';'), lambda t: len(string_split(t, ':')) > 1),
                 lambda t: string_split(t, ':')[1]) AS pcat,
  flatten(list_transform(list_filter(string_split(predict_category_property, ';'),
                                     lambda t: len(string_split(t, ':')) > 1),
          lambda t: CASE WHEN string_split(t, ':')[2] = '-1' THEN []::VARCHAR[]
                    ELSE string_split(string_split(t, ':')[2], ',') END)) AS ppro
  FROM flog)"""
    cols = []
    for prefix, lst, v, n in (("most_proerty", "props", "vq", 10), ("most_predict_cat", "pcat", "pc", 30),
                              ("most_predict_pro", "ppro", "pp", 25)):
        for j in range(n):
            cols.append(f"coalesce(CAST(list_contains({lst}, (SELECT token FROM {v} WHERE rnk = {j})) AS INTEGER), 0)"
                        f" AS {prefix}_{j}")
    return (EV + ",\n" + _vocab_cte("vq", 10, True) + ",\n" + cats + ",\n" + pros + ",\n" + parsed
            + "\nSELECT instance_id, " + ",\n ".join(cols) + "\nFROM pl")


@register("list_multi_hot", _multi_hot_sql())
def q_list_multi_hot(spark, sf):
    df = click_log(spark, sf)
    train = df.where("day < 24")
    props = L.tokens("item_property_list")
    pcat = L.predict_categories("predict_category_property")
    ppro = L.predict_properties("predict_category_property")
    voc = V.vocabularies(train, {"q": (props, 10, True), "c": (pcat, 30, False), "r": (ppro, 25, False)})
    vq, vc, vr = voc["q"], voc["c"], voc["r"]
    return df.select("instance_id", *V.multi_hot(props, vq, "most_proerty", 10),
                     *V.multi_hot(pcat, vc, "most_predict_cat", 30),
                     *V.multi_hot(ppro, vr, "most_predict_pro", 25))


# ------------------------------------------------------- encoders
@register("enc_first_seen", EV + f""",
c1 AS ({_first_seen_sql('flog', 'item_property_list', 'code')}),
c2 AS ({_first_seen_sql('flog', 'user_id', 'code')})
SELECT f.instance_id, c1.code AS item_property_list_code, c2.code AS user_id_code
FROM flog f JOIN c1 ON f.item_property_list IS NOT DISTINCT FROM c1.v
            JOIN c2 ON f.user_id IS NOT DISTINCT FROM c2.v""")
def q_enc_first_seen(spark, sf):
    df = click_log(spark, sf)
    out = EN.first_seen_codes(df, ["item_property_list", "user_id"], ["context_timestamp", "instance_id"], "_code")
    return out.select("instance_id", "item_property_list_code", "user_id_code")


_GROWING = ["item_property_list", "user_id", "shop_id"]


@register("enc_incremental", EV + ",\n" + _codes_sql("flog", _GROWING, ["instance_id"], "enc") + "\nSELECT instance_id, "
          + ", ".join(f"{c} AS {c}_code" for c in _GROWING) + " FROM enc")
def q_enc_incremental(spark, sf):
    """A code table built in three batches of days, then used for all rows."""
    df, codes = click_log(spark, sf), None
    for days in ("day < 8", "day >= 8 AND day < 24", "day >= 24"):
        codes = EN.extended_codes(codes, df.where(days), _GROWING, ["context_timestamp", "instance_id"])
    return EN.coded(df, codes, _GROWING).select("instance_id", *[f"{c}_code" for c in _GROWING])


_JOINT = ["item_id", "user_id", "item_brand_id", "item_city_id", "user_occupation_id", "context_page_id",
          "shop_id", "category_0", "category_1", "category_2", "predict_category_0", "predict_category_1",
          "predict_category_2", "hour", "item_price_level", "item_sales_level", "item_collected_level", "item_pv_level",
          "user_gender_id", "user_age_level", "user_star_level", "is_week", "shop_review_num_level", "shop_star_level"]
_PREDICTED = ", ".join(f"""TRY_CAST(coalesce(split_part(string_split(predict_category_property, ';')[{i + 1}], ':', 1), '-1') AS BIGINT)
    AS predict_category_{i}""" for i in range(3))
_PART = "CASE WHEN day < 24 THEN 'train' WHEN day = 24 THEN 'holdout' ELSE 'test' END"


@register("enc_joint", EV + f",\nu AS (SELECT *, {_PREDICTED} FROM flog),\n"
          + _codes_sql("u", _JOINT, ["instance_id", "day"], "enc") + f"""
SELECT instance_id, {_PART} AS part, {", ".join(_JOINT)} FROM enc""")
def q_enc_joint(spark, sf):
    df = click_log(spark, sf).select("*", *[L.predicted_category("predict_category_property", i).alias(f"predict_category_{i}")
                                            for i in range(3)])
    train, rest = df.where("day < 24"), df.where("day >= 24")
    both = R.union_train_test(train, rest, None)
    enc = EN.first_seen_codes(both.select("instance_id", "day", "context_timestamp", *_JOINT), _JOINT, ["context_timestamp", "instance_id"])
    return enc.select("instance_id", F.expr(_PART).alias("part"), *_JOINT)


_BUCK = ["shop_review_positive_rate", "shop_score_service", "shop_score_delivery", "shop_score_description"]


def _buck_sql():
    ctes = [f"k{i} AS ({_first_seen_sql('b1', c + '_bin', 'code')})" for i, c in enumerate(_BUCK)]
    joins = " ".join(f"JOIN k{i} ON b1.{c}_bin IS NOT DISTINCT FROM k{i}.v" for i, c in enumerate(_BUCK))
    cols = ", ".join(f"b1.{c}_bin, k{i}.code AS {c}_buck" for i, c in enumerate(_BUCK))
    return EV + ",\n" + _bins_sql(_BUCK, "_bin") + ",\n" + ",\n".join(ctes) + \
        f"\nSELECT b1.instance_id, {cols} FROM b1 {joins}"


@register("enc_equal_width", _buck_sql())
def q_enc_equal_width(spark, sf):
    df = R.replace_sentinel(click_log(spark, sf), "shop_review_positive_rate", -1, 0.0)
    df = EN.equal_width_bins(df.select("instance_id", "context_timestamp", *_BUCK), _BUCK, 10, "_bin")
    df = EN.first_seen_codes(df, [f"{c}_bin" for c in _BUCK], ["context_timestamp", "instance_id"], "_code")
    return df.select("instance_id", *[x for c in _BUCK for x in
                                      (F.col(f"{c}_bin"), F.col(f"{c}_bin_code").alias(f"{c}_buck"))])


_STD = ["item_price_level", "item_sales_level", "item_collected_level", "item_pv_level", "user_age_level",
        "user_star_level", "shop_review_num_level", "shop_review_positive_rate", "shop_star_level", "shop_score_service",
        "shop_score_delivery", "shop_score_description", "hour", "user_query_day", "user_query_day_hour"]


@register("enc_standardize", EV + """,
st AS (SELECT *, count(*) OVER (PARTITION BY user_id, day) AS user_query_day,
              count(*) OVER (PARTITION BY user_id, day, hour) AS user_query_day_hour FROM flog),
mm AS (SELECT """ + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _STD) + """ FROM st)
SELECT instance_id, """ + ", ".join(f"round(({c} - mu_{c}) / sd_{c}, 6) AS {c}_std" for c in _STD) + """
FROM st, mm""")
def q_enc_standardize(spark, sf):
    df = C.add_group_sizes(click_log(spark, sf), {g: C.USER_QUERY_COUNTS[g] for g in ("user_query_day", "user_query_day_hour")})
    df = EN.standardize(df, _STD)
    return df.select("instance_id", *[F.round(f"{c}_std", 6).alias(f"{c}_std") for c in _STD])


# ------------------------------------------------------- sparse text rows
from clickfeat.operators import ffm as FF  # noqa: E402
from pyspark.sql import types as T  # noqa: E402
from clickfeat.operators import evaluate as EVL  # noqa: E402
from clickfeat.sources import positions as POS  # noqa: E402
from clickfeat.operators import sample as SMP  # noqa: E402



def _ffm_line_sql():
    """``lines``: one field-aware text row per log row."""
    lists = " || ".join(f"coalesce((SELECT s FROM ls WHERE ls.instance_id = a.instance_id AND ls.f = {i}), '')" for i in range(3))
    scal = " || ".join(f"'{3 + i}:' || CAST({c} AS VARCHAR) || ':1 '" for i, c in enumerate(EP.FFM_SCALARS))
    return _ffm_ctes() + f""",
ls AS (SELECT instance_id, f, string_agg(CAST(f AS VARCHAR) || ':' || CAST(rnk AS VARCHAR) || ':1 ', '' ORDER BY rnk) AS s
       FROM rk GROUP BY instance_id, f),
lines AS (SELECT a.instance_id, a.day, CAST(a.is_trade AS VARCHAR) || ' ' || {lists} || {scal} AS line FROM enc a)
"""


@register("ffm_rows", _ffm_line_sql() + "SELECT instance_id, line FROM lines")
def q_ffm_rows(spark, sf):
    df, scalars = EP.ffm_frame(click_log(spark, sf))
    return FF.ffm_rows(df, "is_trade", EP.LISTS, scalars)


@register("ffm_export", _ffm_line_sql() + """SELECT CASE WHEN day < 24 THEN 'tr' ELSE 'va' END AS part, line FROM lines WHERE day <= 24""")
def q_ffm_export(spark, sf):
    """The reference's export: train and holdout files, read back."""
    out = scratch_path(spark, "ffm")
    EP.export_ffm(click_log(spark, sf), out)
    parts = [spark.read.text(f"{out}/{p}").select(F.lit(p).alias("part"), F.col("value").alias("line")) for p in ("tr", "va")]
    return parts[0].unionByName(parts[1])


def _online_sql():
    """``lines`` with the fields of the feature dictionary (from 3 lists + all scalars on)."""
    first = 3 + len(EP.FFM_SCALARS)
    pairs = [f"SELECT instance_id, '{c}' AS Field, CAST({c} AS VARCHAR) AS Value FROM enc" for c in EP.FFM_SCALARS]
    pairs += [f"SELECT instance_id, '{c}', CAST(rnk AS VARCHAR) FROM rk WHERE f = {i}" for i, c in enumerate(EP.LISTS)]
    freq = _freq_sql()[len(_ffm_ctes()):]
    return _ffm_line_sql() + freq + f""",
named AS (SELECT *, Field || '-' || Value AS feature, round(Pos / Total, 5) AS Ratio FROM ft WHERE Total >= 10),
dict AS (
  SELECT Field, Value, {first} - 1 + row_number() OVER (ORDER BY feature) AS num FROM named
  UNION ALL
  SELECT Field, Value, {first} - 1 + (SELECT count(*) FROM named) + row_number() OVER (ORDER BY Ratio DESC, feature) FROM
    (SELECT * FROM named ORDER BY Ratio DESC, feature LIMIT 100)),
more AS (
  SELECT instance_id, string_agg(CAST(num AS VARCHAR) || ':1:1 ', '' ORDER BY num) AS s
  FROM ({" UNION ALL ".join(pairs)}) JOIN dict USING (Field, Value) GROUP BY instance_id)
"""


@register("ffm_export_online", _online_sql() + """
SELECT CASE WHEN day < 25 THEN 'tr' ELSE 've' END AS part, line || coalesce(s, '') AS line
FROM lines LEFT JOIN more USING (instance_id) WHERE day <= 25""")
def q_ffm_export_online(spark, sf):
    """The online export: all labelled days and the test day, read back."""
    out = scratch_path(spark, "ffm-online")
    EP.export_ffm_online(click_log(spark, sf), out)
    parts = [spark.read.text(f"{out}/{p}").select(F.lit(p).alias("part"), F.col("value").alias("line")) for p in ("tr", "ve")]
    return parts[0].unionByName(parts[1])


@register("ffm_hash", """
SELECT doc_id,
       CAST(CAST('0x' || md5(text) AS UHUGEINT) % 999999 + 1 AS BIGINT) AS h_text,
       CAST(CAST('0x' || md5(lang) AS UHUGEINT) % 999999 + 1 AS BIGINT) AS h_lang,
       'text:' || CAST(CAST('0x' || md5(text) AS UHUGEINT) % 999999 + 1 AS VARCHAR) || ':1 '
         || 'source:' || CAST(CAST('0x' || md5(source) AS UHUGEINT) % 999999 + 1 AS VARCHAR) || ':1' AS tokens
FROM documents""")
def q_ffm_hash(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", L.md5_bucket("text").alias("h_text"), L.md5_bucket("lang").alias("h_lang"),
                    FF.hashed_tokens({"text": "text", "source": "source"}).alias("tokens"))


# ------------------------------------------------------- evaluation and blending (M2, M4, M6)
_P1 = "CAST((instance_id * 37) % 97 + 1 AS DOUBLE) / 99.0"
_P2 = "CAST((instance_id * 53) % 89 + 1 AS DOUBLE) / 91.0"
_P3 = "CAST((instance_id * 11) % 83 + 1 AS DOUBLE) / 85.0"


def _scored(spark, sf, expr=_P1):
    df = click_log(spark, sf)
    return df.select("instance_id", "is_trade", "day", F.expr(_PART).alias("part"),
                     F.expr(expr).alias("predicted_score"))


@register("eval_log_loss", EV + f"""
SELECT part, round(avg(-(is_trade * ln(greatest(least(p, 1 - 1e-15), 1e-15))
                         + (1 - is_trade) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))), 6) AS log_loss,
       CAST(count(*) AS BIGINT) AS rows
FROM (SELECT is_trade, {_PART} AS part, {_P1} AS p FROM flog) GROUP BY part""")
def q_eval_log_loss(spark, sf):
    ll = EVL.log_loss(_scored(spark, sf), by=["part"])
    return ll.select("part", F.round("log_loss", 6).alias("log_loss"), "rows")


@register("eval_accuracy", EV + f"""
SELECT part, round(avg(CAST(CAST(p > 0.5 AS INTEGER) = is_trade AS DOUBLE)), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS rows
FROM (SELECT is_trade, {_PART} AS part, {_P1} AS p FROM flog) GROUP BY part""")
def q_eval_accuracy(spark, sf):
    acc = EVL.accuracy(_scored(spark, sf), by=["part"])
    return acc.select("part", F.round("accuracy", 6).alias("accuracy"), "rows")


@register("blend_scores", EV + f"""
SELECT instance_id, 'train' AS part, round(0.6 * {_P1} + 0.4 * {_P2}, 9) AS predicted_score FROM flog WHERE day < 25
UNION ALL
SELECT instance_id, 'test', round(0.8 * {_P1} + 0.1 * {_P2} + 0.1 * {_P3}, 9) FROM flog WHERE day >= 25""")
def q_blend_scores(spark, sf):
    a, b, c = _scored(spark, sf, _P1), _scored(spark, sf, _P2), _scored(spark, sf, _P3)
    tr = EVL.blend([(a.where("day < 25"), 0.6), (b.where("day < 25"), 0.4)])
    te = EVL.blend([(a.where("day >= 25"), 0.8), (b.where("day >= 25"), 0.1), (c.where("day >= 25"), 0.1)])
    return (tr.select("instance_id", F.lit("train").alias("part"), F.round("predicted_score", 9).alias("predicted_score"))
              .unionByName(te.select("instance_id", F.lit("test").alias("part"),
                                     F.round("predicted_score", 9).alias("predicted_score"))))


@register("blend_log_loss", EV + f"""
SELECT round(avg(-(is_trade * ln(greatest(least(p, 1 - 1e-15), 1e-15))
                  + (1 - is_trade) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))), 6) AS log_loss,
       CAST(count(*) AS BIGINT) AS rows
FROM (SELECT is_trade, 0.6 * {_P1} + 0.4 * {_P2} AS p FROM flog WHERE day < 25)""")
def q_blend_log_loss(spark, sf):
    a, b = _scored(spark, sf, _P1).where("day < 25"), _scored(spark, sf, _P2).where("day < 25")
    bl = EVL.blend([(a, 0.6), (b, 0.4)]).join(a.select("instance_id", "is_trade"), "instance_id")
    return EVL.log_loss(bl).select(F.round("log_loss", 6).alias("log_loss"), "rows")


# ------------------------------------------------------- balanced negative chunks
@register("sample_negative_chunks", EV + """
SELECT instance_id, is_trade, CAST(floor((row_number() OVER (ORDER BY context_timestamp, instance_id) - 1) / 1000)
                                   AS BIGINT) AS chunk
FROM flog WHERE is_trade <> 1
UNION ALL
SELECT instance_id, is_trade, -1 FROM flog WHERE is_trade = 1""")
def q_sample_negative_chunks(spark, sf):
    df = click_log(spark, sf).select("instance_id", "is_trade", "context_timestamp")
    return SMP.negative_chunks(df, 1000, ["context_timestamp", "instance_id"]).select("instance_id", "is_trade", "chunk")


# ------------------------------------------------------- sources and sinks
from clickfeat.session import scratch_path  # noqa: E402
from clickfeat.sources import logs as IO  # noqa: E402
from clickfeat.schema import RAW_LOG  # noqa: E402
from clickfeat.sources.standin import events_log  # noqa: E402


@register("src_read_log", EV + "\nSELECT " + ", ".join(f.name for f in RAW_LOG.fields) + " FROM log")
def q_src_read_log(spark, sf):
    path = scratch_path(spark, "raw-log")
    IO.write_log(events_log(spark, sf), path)
    return IO.read_log(spark, path)


@register("sink_stage_roundtrip", EV + """,
st AS (SELECT instance_id, day,
  coalesce(string_agg(CASE WHEN day < 24 THEN CAST(is_trade AS VARCHAR) ELSE '0' END, ''
                      ORDER BY context_timestamp, instance_id)
           OVER (PARTITION BY user_id, day ORDER BY context_timestamp, instance_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history,
  coalesce(string_agg(CASE WHEN day < 24 THEN CAST(is_trade AS VARCHAR) ELSE '0' END, ''
                      ORDER BY context_timestamp, instance_id)
           OVER (PARTITION BY user_id ORDER BY context_timestamp, instance_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS all_history,
  CAST(count(*) OVER (PARTITION BY user_id, day, half_hour) AS BIGINT) AS user_query_day_half_hour
FROM flog)
SELECT * FROM st""")
def q_sink_stage_roundtrip(spark, sf):
    df = click_log(spark, sf)
    df = W.add_gaps(df, scopes=("day", "all"))
    df = C.add_group_sizes(df, {"user_query_day_half_hour": ["user_id", "day", "half_hour"]})
    path = scratch_path(spark, "stage")
    IO.write_stage(df.select("instance_id", "day", "history", "all_history", "user_query_day_half_hour"), path)
    return IO.read_stage(spark, path).select("instance_id", "day", "history", "all_history", "user_query_day_half_hour")


@register("sink_predictions", EV + f"""
SELECT instance_id, {_P1} AS predicted_score FROM flog WHERE day >= 25""")
def q_sink_predictions(spark, sf):
    scored = _scored(spark, sf)
    sub = click_log(spark, sf).where("day >= 25").select("instance_id")
    out = EVL.attach_scores(sub, scored.select("instance_id", "predicted_score"))
    path = scratch_path(spark, "predictions")
    IO.write_predictions(out, path)
    return IO.read_predictions(spark, path)


_SHUFFLED = "instance_id * 7919 % 1009, instance_id"


@register("sink_ordered", EV + f"""
SELECT instance_id, {_P1} AS predicted_score, row_number() OVER (ORDER BY {_SHUFFLED}) - 1 AS position FROM flog WHERE day >= 25""")
def q_sink_ordered(spark, sf):
    """Scores in the order of a submission of several files: its rows' positions are
    read off the files, and the written predictions hold the same ones."""
    order = [F.expr(e) for e in _SHUFFLED.split(", ")]
    path = scratch_path(spark, "submission")
    asked = click_log(spark, sf).where("day >= 25").select("instance_id", *[e.alias(f"o{i}") for i, e in enumerate(order)])
    IO.write_log(asked.repartitionByRange(5, "o0", "o1").sortWithinPartitions("o0", "o1").select("instance_id"), path)
    sub = POS.with_positions(IO.read_log(spark, path, T.StructType([T.StructField("instance_id", T.LongType())])))
    scored = _scored(spark, sf).select("instance_id", "predicted_score")
    out = scratch_path(spark, "ordered-predictions")
    IO.write_predictions(POS.in_order(EVL.attach_scores(sub, scored)).select("instance_id", "predicted_score"), out)
    return POS.with_positions(IO.read_predictions(spark, out)).select("instance_id", "predicted_score", "position")


@register("sink_freq_table", _freq_sql() + """
SELECT Field, Value, Neg, Pos, Total, round(Pos / Total, 5) AS Ratio FROM ft WHERE Total >= 10""")
def q_sink_freq_table(spark, sf):
    t = _freq_table(spark, sf)
    path = scratch_path(spark, "freq")
    IO.write_freq_table(t, path)
    return IO.read_freq_table(spark, path)


# ------------------------------------------------------- composed pipelines
from clickfeat.plans import features as FT  # noqa: E402


def _oracle_join(names):
    parts = [f"(\n{ORACLE[n]}\n) q{i}" for i, n in enumerate(names)]
    sql = "SELECT * FROM " + parts[0]
    for p in parts[1:]:
        sql += "\nJOIN " + p + " USING (instance_id)"
    return sql


def _compact_sql():
    counts = _count_sql({"user_query_day": ["user_id", "day"], "user_query_day_hour": ["user_id", "day", "hour"]})
    more = EV + """
SELECT instance_id, CAST(len(string_split(item_property_list, ';')) AS BIGINT) AS item_property_num,
       CAST(row_number() OVER (PARTITION BY item_id, user_id ORDER BY context_timestamp, instance_id) AS BIGINT)
         AS sum_Times
FROM flog"""
    subs = [ORACLE["list_vocab_overlap"], ORACLE["list_predicted_category"], counts, ORACLE["rate_smoothed"],
            ORACLE["prior_trade_item"], more]
    ids = EV + f""",
base AS (SELECT f.*, o.most_property, o.trade_most_property, {_PREDICTED}
         FROM flog f JOIN ({ORACLE["list_vocab_overlap"]}) o USING (instance_id)),
""" + _codes_sql("base", FT.ID_COLUMNS, ["instance_id"], "enc") + "\nSELECT instance_id, " + \
        ", ".join(f"{c} AS {c}_code" for c in FT.ID_COLUMNS) + " FROM enc"
    parts = [f"(\n{q}\n) q{i}" for i, q in enumerate([*subs, ids])]
    sql = "SELECT q0.instance_id, q0.most_property_num, q0.trade_most_property_num, " + \
        ", ".join(f"q{i}.* EXCLUDE (instance_id)" for i in range(1, len(parts))) + "\nFROM " + parts[0]
    for i, p in enumerate(parts[1:], 1):
        sql += f"\nJOIN {p} ON q0.instance_id = q{i}.instance_id"
    return sql


_COMPACT_OUT = ["instance_id", "most_property_num", "trade_most_property_num", "predict_category_0",
                "predict_category_1", "predict_category_2", "user_query_day", "user_query_day_hour",
                *[c for st in RT.RATE_KEYS.values() for c in (f"{st}_count", f"trade_{st}_count", f"{st}_ctr")],
                "show", "trade_no", "item_property_num", "sum_Times", *[f"{c}_code" for c in FT.ID_COLUMNS]]


@register("features_compact", _compact_sql())
def q_features_compact(spark, sf):
    out = FT.compact_features(click_log(spark, sf))
    return out.select(*_COMPACT_OUT)


def _hist4_sql():
    cols = []
    for sc in W.SCOPES.values():
        keys, _, hist = sc
        cols.append(f"""coalesce(string_agg(CASE WHEN day < 24 THEN CAST(is_trade AS VARCHAR) ELSE '0' END, ''
                      ORDER BY context_timestamp, instance_id)
           OVER (PARTITION BY {_in(keys)} ORDER BY context_timestamp, instance_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS {hist}""")
    return EV + "\nSELECT instance_id, day, " + ",\n ".join(cols) + "\nFROM flog"


def _full_out(df):
    keep = ["instance_id"]
    for s in W.SCOPES.values():
        keep += [f"{s[1]}diff_{i}" for i in range(1, 5)] + [s[2], f"{s[2]}_code"]
    keep += list(FT.ALL_COUNTS) + ["user_day", "cat_1_user_show", "cat_1_trade_no", "shop_user_show", "shop_trade_no"]
    keep += list(W.ORDINALS) + [c for c in df.columns if c.endswith("_first_day") or c.endswith("_last_day")]
    keep += [c for c in df.columns if c.startswith("most_")]
    return df.select(*keep)


def _full_sql():
    subs = []
    for sc in W.SCOPES:
        subs += [ORACLE[f"gap_{sc}"], ORACLE[f"history_{sc}"]]
    subs.append(_count_sql({**FT.ALL_COUNTS, "user_day": ["user_id", "day"]}))
    for name in ("cat", "shop"):
        subs.append(ORACLE[f"prior_trade_{name}"])
    subs += [ORACLE["ordinal_click"], ORACLE["ordinal_first_last"], ORACLE["list_multi_hot"]]
    texts = [sc[2] for sc in W.SCOPES.values()]
    subs.append(EV + f""",
h4 AS (SELECT h.*, f.context_timestamp FROM ({_hist4_sql()}) h JOIN flog f USING (instance_id)),
""" + _codes_sql("h4", texts, ["instance_id"], "enc") + "\nSELECT instance_id, " + ", ".join(f"{c} AS {c}_code" for c in texts) + " FROM enc")
    parts = [f"(\n{q}\n) q{i}" for i, q in enumerate(subs)]
    sql = "SELECT q0.instance_id, " + ", ".join(f"q{i}.* EXCLUDE (instance_id)" for i in range(len(parts))) + \
          "\nFROM " + parts[0]
    for i, p in enumerate(parts[1:], 1):
        sql += f"\nJOIN {p} ON q0.instance_id = q{i}.instance_id"
    return sql


@register("features_full", _full_sql())
def q_features_full(spark, sf):
    return _full_out(FT.full_features(click_log(spark, sf), history_texts=True))


# ------------------------------------------------------- pyspark.ml jobs (rows-only checks)
from clickfeat.operators import fieldaware as FFA  # noqa: E402
from clickfeat.operators import learn as ML  # noqa: E402
from clickfeat.operators import rounds as RO  # noqa: E402
from clickfeat.operators import trees as TR  # noqa: E402


def _ml_frame(spark, sf):
    """The model's frame, built once and written: fitting reads it many times.  The
    log's texts, which no model reads, are not built for it."""
    df = FT.full_features(click_log(spark, sf), with_history=False, multi_hot=False)
    feats = FT.numeric_features(df)
    keep = [c for c in ("instance_id", "is_trade", "day", "context_timestamp") if c not in feats]
    return EN.staged(df.select(*keep, *feats), "model-frame", wide=True), feats


def _gbt_score(df, feats):
    model = ML.fit_gbt(df.where("day < 24"), feats, max_iter=20, max_depth=4)
    return ML.score(model, df, feats, keep=["day"])


@register("ml_gbt_score")
def q_ml_gbt_score(spark, sf):
    return _gbt_score(*_ml_frame(spark, sf))


@register("ml_temporal_eval")
def q_ml_temporal_eval(spark, sf):
    df, feats = _ml_frame(spark, sf)
    model = ML.fit_gbt(df.where("day < 24"), feats, max_iter=20, max_depth=4)
    s = ML.score(model, df, feats, keep=["day"])
    s = s.withColumn("part", F.expr(_PART))
    return EVL.log_loss(s, by=["part"])


@register("ml_leaf_features")
def q_ml_leaf_features(spark, sf):
    df, feats = _ml_frame(spark, sf)
    model = ML.fit_gbt(df.where("day < 24"), feats, max_iter=8, max_depth=3, leaf_col="leaves")
    leaves = ML.leaf_features(model, df, feats)
    cols = [c for c in leaves.columns if c.startswith("xgb_")]
    # the reference hands leaf features over as a space-delimited file (S3)
    path = scratch_path(spark, "leaves")
    IO.write_log(leaves, path)
    back = IO.read_leaf_features(spark, path, len(cols))
    return EN.first_seen_codes(back, cols, ["instance_id"])


def _fm_score(df, feats):
    model = ML.fit_fm(df.where("day < 24"), feats, max_iter=20)
    return ML.score(model, df, feats, keep=["day"])


@register("ml_fm_score")
def q_ml_fm_score(spark, sf):
    return _fm_score(*_ml_frame(spark, sf))


@register("ml_ffm_score")
def q_ml_ffm_score(spark, sf):
    """Field-aware factorisation over the rows of the offline export, learnt before day 24."""
    df, scalars = EP.ffm_frame(click_log(spark, sf))
    rows = EN.staged(df.select("instance_id", "is_trade", "day", FFA.features(EP.LISTS, scalars).alias("features")), "ffm-features", wide=True)
    n = len(EP.LISTS) + len(scalars)
    params, _ = FFA.fit(rows.where("day < 24"), n, rounds=4)
    return FFA.predict(rows, params, n, keep=["day"])


@register("ml_early_stop")
def q_ml_early_stop(spark, sf):
    """Losses of every iteration up to the number of trees that day 24 chooses."""
    df, feats = _ml_frame(spark, sf)
    return ML.fit_gbt_early(df.where("day <= 24"), F.col("day") == 24, feats, max_iter=12, max_depth=3)[1]


@register("ml_early_stop_check", EV + """
SELECT CAST(1 AS BIGINT) AS chosen, CAST(0 AS BIGINT) AS gaps, TRUE AS chosen_is_last, TRUE AS chosen_is_best,
       (SELECT count(*) FROM flog WHERE day < 24) AS fitted, (SELECT count(*) FROM flog WHERE day = 24) AS judged""")
def q_ml_early_stop_check(spark, sf):
    """What holds for any model: iterations without gaps, one chosen, the last, whose
    holdout loss no earlier iteration undercuts; and the rows of either part."""
    t, days = q_ml_early_stop(spark, sf), click_log(spark, sf)
    best = F.min_by("iteration", F.struct("holdout_loss", F.col("iteration")))
    out = t.agg(F.count(F.when(F.col("chosen"), 1)).alias("chosen"), (F.max("iteration") - F.count(F.lit(1))).cast("bigint").alias("gaps"),
                F.max_by("chosen", "iteration").alias("chosen_is_last"),
                (best == F.max(F.when(F.col("chosen"), F.col("iteration")))).alias("chosen_is_best"))
    parts = days.agg(F.count(F.when(F.col("day") < 24, 1)).alias("fitted"), F.count(F.when(F.col("day") == 24, 1)).alias("judged"))
    return out.withColumn("one", F.lit(1)).join(parts.withColumn("one", F.lit(1)), "one").drop("one")


@register("ml_leaf_check", EV + """
SELECT CAST(8 AS BIGINT) AS trees, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS other_leaves, CAST(0 AS BIGINT) AS other_paths,
       CAST(0 AS BIGINT) AS other_scores FROM flog""")
def q_ml_leaf_check(spark, sf):
    """The trainer's leaves and scores against the tree table: the CASE form of every
    tree, and the path of every reported leaf."""
    df, feats = _ml_frame(spark, sf)
    model = ML.fit_gbt(df.where("day < 24"), feats, max_iter=8, max_depth=3, leaf_col="leaves")
    names = [f"xgb_{t + 1}" for t in range(model.stages[-1].getNumTrees)]
    cases = [c.alias(f"__{n}") for n, c in zip(names, TR.leaf_columns(model, feats))]
    ours = [f"__{n}" for n in names] + ["predicted_score"]
    # one scan: each form is added to the row that has the others, so nothing is joined by key
    scored = ML.score(model, df.select("*", *cases, TR.score_column(model, feats).alias("__case")), feats, keep=[*feats, *ours[:-1], "__case"])
    both = ML.leaf_features(model, scored, feats, keep=[*feats, *ours, "__case"])
    # every path predicate of the leaf that the trainer reports
    checked = TR.path_checks(both, TR.tree_table(spark, model, feats), names, keep=[*names, *ours, "__case"])
    apart = sum((F.col(n) != F.col(f"__{n}")).cast("int") for n in names)
    return checked.agg(F.lit(len(names)).cast("bigint").alias("trees"), F.count(F.lit(1)).alias("rows"),
                       F.coalesce(F.sum(apart), F.lit(0)).cast("bigint").alias("other_leaves"),
                       F.coalesce(F.sum("other_paths"), F.lit(0)).cast("bigint").alias("other_paths"),
                       F.count(F.when(F.abs(F.col("predicted_score") - F.col("__case")) > 1e-9, 1)).alias("other_scores"))


@register("ffm_export_leaves", _online_sql() + """
SELECT CASE WHEN day < 25 THEN 'tr' ELSE 've' END AS part, line || coalesce(s, '') AS line, CAST(6 AS BIGINT) AS leaf_fields
FROM lines LEFT JOIN more USING (instance_id) WHERE day <= 25""")
def q_ffm_export_leaves(spark, sf):
    """The online export with the leaf fields of a model fitted before day 25: how
    many a row has behind the dictionary's fields, and the row without them."""
    df, feats = _ml_frame(spark, sf)
    model = ML.fit_gbt(df.where("day < 25"), feats, max_iter=6, max_depth=3)
    leaves = df.select("instance_id", *TR.leaf_columns(model, feats))
    out = scratch_path(spark, "ffm-leaves")
    dictionary = EP.export_ffm_online(click_log(spark, sf), out, leaves=leaves)
    last = dictionary.agg(F.max("num")).first()[0]
    first = len(EP.LISTS) + len(EP.FFM_SCALARS) - 1 if last is None else last
    rows = [spark.read.text(f"{out}/{p}").select(F.lit(p).alias("part"), "value") for p in ("tr", "ve")]
    # the leaf fields are whole tokens, so what follows the seventh blank from the end holds them
    tail = F.substring_index("value", " ", -7)
    line = F.concat(F.expr("left(value, length(value) - length(substring_index(value, ' ', -7)))"), F.regexp_replace(tail, r"([0-9]+:[0-9]+:1 ){6}$", ""))
    return FF.fields_above(rows[0].unionByName(rows[1]).select("part", "value", line.alias("line")), "value", first, "leaf_fields").drop("value")


@register("ml_online_score", EV + """
SELECT instance_id, TRUE AS in_range FROM flog WHERE day = 25""")
def q_ml_online_score(spark, sf):
    """The second split: fitted on all labelled days (< 25), day 25 scored, written
    and read back as the submission is."""
    df, feats = _ml_frame(spark, sf)
    model = ML.fit_gbt(df.where("day < 25"), feats, max_iter=10, max_depth=4)
    path = scratch_path(spark, "online-predictions")
    IO.write_predictions(ML.score(model, df.where("day = 25"), feats).select("instance_id", "predicted_score"), path)
    return IO.read_predictions(spark, path).select("instance_id", F.col("predicted_score").between(0, 1).alias("in_range"))


def _rounds(spark, sf):
    """The frame, its numeric features and the labelled days (< 25) in rounds."""
    df, feats = _ml_frame(spark, sf)
    return df, feats, RO.chunks(df.where("day < 25"), ["context_timestamp", "instance_id"])


@register("ml_rounds_score", EV + """
SELECT instance_id, day, TRUE AS in_range FROM flog WHERE day = 25""")
def q_ml_rounds_score(spark, sf):
    """One model a round of balanced negative chunks, fitted together on the labelled
    days; day 25 gets the mean of their scores, written and read back."""
    df, feats, chunked = _rounds(spark, sf)
    scored = RO.score(RO.fit(chunked, feats), df.where("day = 25"))
    path = scratch_path(spark, "rounds-predictions")
    IO.write_predictions(scored, path)
    back = IO.read_predictions(spark, path)
    return back.select("instance_id", F.lit(25).alias("day"), F.col("predicted_score").between(0, 1).alias("in_range"))


@register("ml_rounds_sizes", EV + f""",
n AS (SELECT CAST(sum(coalesce(is_trade, 0)) AS BIGINT) AS pos, CAST(count(*) - sum(coalesce(is_trade, 0)) AS BIGINT) AS neg FROM flog WHERE day < 25),
z AS (SELECT pos, neg, greatest(1, pos, CAST(ceil(neg / {RO.MAX_ROUNDS}.0) AS BIGINT)) AS size FROM n)
SELECT CAST(k AS BIGINT) AS chunk, pos AS positives, CAST(least(size, neg - k * size) AS BIGINT) AS negatives
FROM z, range({RO.MAX_ROUNDS}) r(k) WHERE k * size < neg""")
def q_ml_rounds_sizes(spark, sf):
    """Rows of every round: each positive in each, each negative in one."""
    log = click_log(spark, sf).where("day < 25").select("instance_id", "is_trade", "context_timestamp")
    return RO.round_sizes(RO.chunks(log, ["context_timestamp", "instance_id"]))


# Jobs over the model's frame, and the job with rows of its own.
_FRAME_JOBS = {"ml_gbt_score": _gbt_score, "ml_fm_score": _fm_score}
_CHECKED = (*_FRAME_JOBS, "ml_ffm_score")


@register("ml_score_check", EV + f"""
SELECT m.job, {_PART} AS part, CAST(count(*) AS BIGINT) AS rows, CAST(sum(is_trade) AS BIGINT) AS trades,
       CAST(count(DISTINCT instance_id) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS bad_scores
FROM flog, (VALUES {", ".join(f"('{j}')" for j in _CHECKED)}) m(job) GROUP BY 1, 2""")
def q_ml_score_check(spark, sf):
    """What can be known of the scored frames without the model: every row once,
    its label and part, a score within [0, 1].  The jobs over the model's frame share one."""
    out, frame = None, _ml_frame(spark, sf)
    for job in _CHECKED:
        s = _FRAME_JOBS[job](*frame) if job in _FRAME_JOBS else QUERIES[job](spark, sf)
        good = F.coalesce(F.col("predicted_score").between(0, 1), F.lit(False))
        g = s.groupBy(F.lit(job).alias("job"), F.expr(_PART).alias("part")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("is_trade").alias("trades"), F.countDistinct("instance_id").alias("keys"),
            F.sum((~good).cast("long")).alias("bad_scores"))
        out = g if out is None else out.unionByName(g)
    return out


# ------------------------------------------------------- streaming (incremental G10)
from clickfeat.streaming import stats as ST  # noqa: E402
from clickfeat.sources.standin import events_to_log  # noqa: E402
from clickfeat.plans.base import add_time_and_category  # noqa: E402


@register("stream_daily_cvr", ORACLE["profile_daily_cvr"])
def q_stream_daily_cvr(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = ST.file_stream(spark, sf, "event[s].parquet", schema)
    log = add_time_and_category(events_to_log(stream), category_list=None).select("day", "is_trade")
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    ST.run_partial_stats(log, ["day"], out, ck)
    return ST.totals(spark, out, ["day"])


# ------------------------------------------------------- staged CSV with explicit types
from pyspark.sql import types as T  # noqa: E402

STAGE_SCHEMA = T.StructType([T.StructField("instance_id", T.LongType()), T.StructField("day", T.IntegerType()),
                             T.StructField("history", T.StringType()), T.StructField("all_history", T.StringType()),
                             T.StructField("item_history", T.StringType()),
                             T.StructField("cat1_history", T.StringType())])


@register("src_read_stage", _hist4_sql())
def q_src_read_stage(spark, sf):
    """The reference's text stage: histories like ``0010`` must come back as
    strings (explicit schema) and an empty history as an empty string."""
    df = W.add_gaps(click_log(spark, sf))
    path = scratch_path(spark, "csv-stage")
    IO.write_log(df.select(*[f.name for f in STAGE_SCHEMA.fields]), path, null_value=IO.STAGE_NULL)
    return IO.read_log(spark, path, STAGE_SCHEMA, null_value=IO.STAGE_NULL)


# ------------------------------------------------------- ideas from the notes (optional, §2.13)
@register("rate_bayes", EV + """,
g AS (SELECT item_id, CAST(count(*) AS BIGINT) AS clicks, CAST(sum(is_trade) AS BIGINT) AS trades FROM flog
      GROUP BY item_id),
m AS (SELECT avg(CAST(trades AS DOUBLE) / clicks) AS mu, var_pop(CAST(trades AS DOUBLE) / clicks) AS v FROM g),
ab AS (SELECT CASE WHEN v > 0 THEN mu * (mu * (1 - mu) / v - 1) ELSE 0 END AS a,
              CASE WHEN v > 0 THEN (1 - mu) * (mu * (1 - mu) / v - 1) ELSE 0 END AS b FROM m)
SELECT item_id, clicks, trades, round((trades + a) / (clicks + a + b), 6) AS bayes_ctr FROM g, ab""")
def q_rate_bayes(spark, sf):
    out = RT.bayes_smoothed_rate(click_log(spark, sf), "item_id")
    return out.select("item_id", "clicks", "trades", F.round("bayes_ctr", 6).alias("bayes_ctr"))


@register("clicks_recent", EV + """
SELECT instance_id,
  CAST(count(*) OVER (PARTITION BY user_id ORDER BY context_timestamp
                      RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS clicks_last_hour,
  CAST(count(*) OVER (PARTITION BY user_id, item_id ORDER BY context_timestamp
                      RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS item_clicks_last_hour,
  CAST(max(context_timestamp) OVER (PARTITION BY user_id, day) - min(context_timestamp) OVER (PARTITION BY user_id, day)
       AS DOUBLE) / 60 AS day_span_minutes
FROM flog""")
def q_clicks_recent(spark, sf):
    return W.add_recent_clicks(click_log(spark, sf), 3600).select(
        "instance_id", "clicks_last_hour", "item_clicks_last_hour", "day_span_minutes")


@register("score_mean_adjust", EV + f""",
tgt AS (SELECT avg(CAST(is_trade AS DOUBLE)) AS r FROM flog
        WHERE day = (SELECT max(day) FROM flog WHERE day < 24)),
sc AS (SELECT instance_id, {_P1} AS p FROM flog WHERE day = 24),
m AS (SELECT avg(p) AS mp FROM sc)
SELECT instance_id, round(p * (r / mp), 9) AS predicted_score FROM sc, tgt, m""")
def q_score_mean_adjust(spark, sf):
    df = click_log(spark, sf)
    target = EVL.latest_day_rate(df, 24)
    s = _scored(spark, sf).where("day = 24").select("instance_id", "predicted_score")
    out = EVL.mean_adjust(s, target)
    return out.select("instance_id", F.round("predicted_score", 9).alias("predicted_score"))
