"""Smoothed conversion rates (G6) and the feature-value label table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clickfeat.operators.ordered import CHUNK_ROWS, split_anchors


# key column -> output stem; outputs {stem}_count, trade_{stem}_count, {stem}_ctr
RATE_KEYS = {
    "item_id": "item",
    "user_id": "user",
    "shop_id": "shop",
    "category_0": "cat_0",
    "category_1": "cat_1",
    "category_2": "cat_2",
}


def add_smoothed_rates(df: DataFrame, stats: DataFrame, keys: dict | None = None,
                       label: str = "is_trade", prior: float = 10.0, row_key: str = "instance_id") -> DataFrame:
    """Per key impressions, trades and ``trades / (impressions + 10)``.

    Trades are NULL (not 0) for a key without any trade, so the rate is NULL
    too, exactly as the reference's left merge; fill at the model boundary.
    The category rates divide by the category's count (the reference divided
    by the category id).
    """
    keys = keys or RATE_KEYS
    from clickfeat.operators.counts import add_group_sizes
    groups = {f"{stem}_count": [k] for k, stem in keys.items()}
    trades = {f"{stem}_count": f"trade_{stem}_count" for stem in keys.values()}
    # every key's impressions and trades in one aggregation (see counts.py)
    out = add_group_sizes(df, groups, key=row_key, population=stats, label=label, trades=trades)
    rates = [(F.col(f"trade_{stem}_count") / (F.col(f"{stem}_count") + F.lit(prior))).alias(f"{stem}_ctr")
             for stem in keys.values()]
    return out.select(*df.columns, *[c for stem in keys.values() for c in
                                     (F.col(f"{stem}_count"), F.col(f"trade_{stem}_count"))], *rates)


def _before(totals: DataFrame, key: str, ts: str, chunk_rows: int) -> DataFrame:
    """``key, ts, n, t`` (one row each) -> with the sums ``__n``, ``__t`` over the key's
    earlier times.  A key with more than ``chunk_rows`` times is cut into chunks
    and the sums are carried over them."""
    plain, chunked = split_anchors(totals, key, ts, "n", chunk_rows)

    def running(d, *group):
        w = Window.partitionBy(key, *group).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
        return d.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__{c}") for c in ("n", "t")])

    out = running(plain)
    if chunked is None:
        return out
    each = chunked.groupBy(F.col(key).alias("__k"), F.col("__chunk").alias("__c")).agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    along = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("__k", "__c", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"__before_{c}") for c in ("n", "t")])
    hot = running(chunked, "__chunk").join(each, (F.col(key) == F.col("__k")) & (F.col("__chunk") == F.col("__c")))
    return out.unionByName(hot.select(key, ts, "n", "t", *[(F.col(f"__{c}") + F.col(f"__before_{c}")).alias(f"__{c}") for c in ("n", "t")]))


def add_strict_rates(df: DataFrame, keys: dict | None = None, label: str = "is_trade", ts: str = "context_timestamp", prior: float = 10.0,
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """G6 without leaks: ``{stem}_before``, ``trade_{stem}_before`` and
    ``{stem}_strict_ctr`` count a key's impressions and trades at strictly earlier
    times, so no row sees its own label or one of the same second.

    Rows are first added up to one row for each key and time (a partial
    aggregate), which is where a hot item, shop or category shrinks; running
    sums over it are cut and carried, and joined back on (key, time), which is
    spread even where the key is hot.  A NULL key or time has NULL counts."""
    out = df
    for key, stem in (keys or RATE_KEYS).items():
        y = F.coalesce(F.col(label), F.lit(0)).cast("bigint")
        totals = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, ts).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("t"))
        sums = _before(totals, key, ts, chunk_rows).select(
            F.col(key).alias(f"__k_{stem}"), F.col(ts).alias(f"__t_{stem}"), F.col("__n").cast("bigint").alias(f"{stem}_before"),
            F.col("__t").cast("bigint").alias(f"trade_{stem}_before"))
        on = (F.col(key) == F.col(f"__k_{stem}")) & (F.col(ts) == F.col(f"__t_{stem}"))
        out = out.join(sums, on, "left").drop(f"__k_{stem}", f"__t_{stem}")
        out = out.withColumn(f"{stem}_strict_ctr", F.col(f"trade_{stem}_before") / (F.col(f"{stem}_before") + F.lit(prior)))
    return out


def bayes_smoothed_rate(df: DataFrame, key: str, label: str = "is_trade") -> DataFrame:
    """Method-of-moments Beta prior per the notes' idea: ``(C+α)/(I+α+β)``.

    α, β come from the mean and variance of the per-key raw rates (one tiny
    global aggregate); returns ``key, clicks, trades, bayes_ctr``.
    """
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("clicks"),
                            F.sum(F.col(label)).cast("bigint").alias("trades"))
    r = F.col("trades") / F.col("clicks")
    # Two scalars reach the driver; they become literals of the final plan.
    m = g.agg(F.avg(r).alias("mu"), F.var_pop(r).alias("var")).first()
    mu, var = (m["mu"] or 0.0), (m["var"] or 0.0)
    if var > 0:
        common = mu * (1 - mu) / var - 1
        a, b = mu * common, (1 - mu) * common
    else:
        a = b = 0.0
    return g.select(key, "clicks", "trades",
                    ((F.col("trades") + F.lit(a)) / (F.col("clicks") + F.lit(a + b))).alias("bayes_ctr"))


def _named(field: str):
    def pair(v):
        return F.struct(F.lit(field).alias("Field"), v.cast("string").alias("Value"))
    return pair


def feature_value_table(df: DataFrame, scalar_fields: list[str], list_fields: list[str] | None = None,
                        label: str = "is_trade", min_total: int = 10) -> DataFrame:
    """``Field Value Neg Pos Total Ratio`` for every field value.

    Scalar fields and the elements of list (array) fields are exploded in one
    scan, then one ``groupBy(Field, Value)`` with map-side combine; rows
    with ``Total < min_total`` are dropped, ``Ratio = round(Pos/Total, 5)``.
    """
    pairs = F.array(*[_named(c)(F.col(c)) for c in scalar_fields]) if scalar_fields else None
    for c in list_fields or []:
        own = F.coalesce(F.transform(c, _named(c)), F.array().cast("array<struct<Field:string,Value:string>>"))
        pairs = own if pairs is None else F.concat(pairs, own)
    long = df.select(F.col(label).alias("__y"), F.explode(pairs).alias("__f")).select("__y", "__f.Field", "__f.Value")
    g = long.groupBy("Field", "Value").agg(
        F.sum(F.when(F.col("__y") == 1, 0).otherwise(1)).cast("bigint").alias("Neg"),
        F.sum(F.when(F.col("__y") == 1, 1).otherwise(0)).cast("bigint").alias("Pos"),
        F.count(F.lit(1)).cast("bigint").alias("Total"))
    return (g.where(F.col("Total") >= min_total)
             .select("Field", "Value", "Neg", "Pos", "Total",
                     F.round(F.col("Pos") / F.col("Total"), 5).alias("Ratio")))


def coded_value_table(values: DataFrame, df: DataFrame, scalar_fields: list[str], list_fields: list[str] | None = None,
                      label: str = "is_trade", min_total: int = 10) -> DataFrame:
    """G8/K3 for first-seen codes, out of the fields' raw values: the statistics of a
    code are those of its value, so ``values`` (``encode.value_table`` with label,
    of ``scalar_fields``) are counted first and only the distinct values are
    numbered; no row of the log is encoded or joined.  The elements of
    ``list_fields`` are counted in ``df`` as they are."""
    from clickfeat.operators.encode import numbered_values
    name = F.element_at(F.array(*[F.lit(f) for f in scalar_fields]), F.col("g") + 1)
    total = (F.col("Neg") + F.col("Pos")).alias("Total")
    coded = numbered_values(values).select(name.alias("Field"), F.col("code").cast("string").alias("Value"), "Neg", "Pos", total)
    coded = coded.where(F.col("Total") >= min_total).select("*", F.round(F.col("Pos") / F.col("Total"), 5).alias("Ratio"))
    return coded.unionByName(feature_value_table(df, [], list_fields, label, min_total)) if list_fields else coded


def frequent_features(table: DataFrame, threshold: int = 10) -> DataFrame:
    """``Field-Value`` names of rows with ``Total >= threshold``."""
    return table.where(F.col("Total") >= threshold).select(
        F.concat_ws("-", "Field", "Value").alias("feature"), "Total", "Ratio")


def high_ratio_features(table: DataFrame, k: int = 100, threshold: int = 10) -> DataFrame:
    """The ``k`` highest-ratio frequent features (top-k is the feature).

    The reference sliced ``[-101:-1]`` and so skipped the very best; we keep
    it.  Ties break by name so the result is deterministic.
    """
    f = frequent_features(table, threshold)
    return f.orderBy(F.col("Ratio").desc(), F.col("feature")).limit(k)
