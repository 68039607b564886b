"""Prior-purchase features.

For a pair (e.g. user × category) the statistics frame gives the pair's
number of clicks (``*_show``) and its latest trade time; a click is flagged
``*_trade_no = 0`` if it happens *after* that trade, else 1 (also 1 when
the pair never traded).  The reference meant "latest trade" but dropped its
sort (it took the first in file order); we take ``max``.  Statistics come
from ``stats`` (train) and are applied to ``df`` (train and test), as in the
reference.  One partial aggregate + one left join per pair: skew-safe (hot
pairs pre-aggregate map-side; AQE splits skewed join partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickfeat.operators.ordered import CHUNK_ROWS, add_scopes

# name -> (pair keys, show column, flag column)
PRIOR_PAIRS = {
    "cat": (["category_1", "user_id"], "cat_1_user_show", "cat_1_trade_no"),
    "shop": (["shop_id", "user_id"], "shop_user_show", "shop_trade_no"),
    "item": (["item_id", "user_id"], "show", "trade_no"),
}


def prior_trade(df: DataFrame, stats: DataFrame, pair: list[str], show: str, flag: str,
                ts: str = "context_timestamp", label: str = "is_trade", strict: bool = False,
                key: str = "instance_id", max_group_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``strict``: a row sees only the clicks and trades of ``stats`` strictly
    before it (by time, then key), so no training row sees its own label or a
    later one: the flag is 0 once the pair has traded before, else 1."""
    if strict:
        return _strict(df, stats, pair, show, flag, ts, label, key, max_group_rows)
    t = (stats.groupBy(*pair)
              .agg(F.count(F.lit(1)).alias(show),
                   F.max(F.when(F.col(label) == 1, F.col(ts))).alias("__trade_time")))
    out = df.join(t, pair, "left")
    tt = F.col("__trade_time")
    fl = F.when(tt.isNull() | (F.col(ts) <= tt), F.lit(1)).otherwise(F.lit(0))
    return out.select(*df.columns, F.col(show).cast("bigint").alias(show), fl.alias(flag))


def add_prior_trades(df: DataFrame, stats: DataFrame, pairs=("cat", "shop", "item"), **kw) -> DataFrame:
    for p in pairs:
        keys, show, flag = PRIOR_PAIRS[p]
        df = prior_trade(df, stats, keys, show, flag, **kw)
    return df


def _strict(df, stats, pair, show, flag, ts, label, key, max_group_rows):
    """All rows and the statistics' rows in one order per pair (a row of both
    comes first as the row, then as the statistic): a row's ordinal less its
    ordinal among the rows is the number of statistics before it, and the
    earliest trade decides the flag."""
    anchor = "user_id" if "user_id" in pair else pair[0]
    rows = df.select(key, *pair, ts, F.lit(0).alias("__s"))
    seen = stats.select(key, *pair, ts, F.lit(1).alias("__s"))
    both = rows.unionByName(seen).withColumn("__at", F.struct(F.col(key), F.col("__s")))
    every = add_scopes(both, {"__a": (pair, ("rn",))}, ts, "__at", anchor, max_group_rows).where("__s = 0")
    own = add_scopes(rows, {"__b": (pair, ("rn",))}, ts, key, anchor, max_group_rows)
    before = every.select(key, "__a__rn").join(own.select(key, "__b__rn"), key).select(
        F.col(key).alias("__key"), (F.col("__a__rn") - F.col("__b__rn")).alias("__before"))
    first = (stats.where(F.col(label) == 1).groupBy(*[F.col(p).alias(f"__{p}") for p in pair])
                  .agg(F.min(F.struct(ts, key)).alias("__first")))
    out = df.join(before, df[key] == before["__key"], "left").join(first, [df[p] == first[f"__{p}"] for p in pair], "left")
    traded = F.col("__first") < F.struct(df[ts], df[key])
    return out.select(*[df[c] for c in df.columns], F.nullif(F.col("__before"), F.lit(0)).cast("bigint").alias(show),
                      F.when(traded, F.lit(0)).otherwise(F.lit(1)).alias(flag))
