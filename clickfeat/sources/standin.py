"""Stand-in click logs derived from the shared test tables.

The reference reads one wide impression/click log (27 columns, see
``clickfeat.schema.RAW_LOG``).  The test tables carry no such log, so every
column is *derived* from them with plain expressions (``FIXTURES.md`` §3):
the work of every query therefore grows with the tables.  The same
derivations exist as DuckDB SQL in ``clickfeat.plans.oracle_base``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickfeat.functions.time import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c):
    return c.cast("string")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the raw click log (one row per event, key ``instance_id``)."""
    return events_to_log(table(spark, sf_dir, "events"))


def events_to_log(ev: DataFrame) -> DataFrame:
    """Row-wise derivation of the log from ``events`` rows (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    u = F.col("user_id")
    v = F.col("value")
    ev = ev.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    k = F.col("k")
    return ev.select(
        F.col("event_id").alias("instance_id"),
        k.alias("item_id"),
        F.concat_ws(";", F.lit("1"), _s(k % 13), F.when(k % 4 != 0, _s(k % 3))).alias("item_category_list"),
        F.concat_ws(";", F.concat(F.lit("p"), _s(k % 10)), F.concat(F.lit("p"), _s(k % 7 + 10)),
                    F.concat(F.lit("p"), _s((k + u) % 5 + 20)),
                    F.when(k % 5 == 0, F.concat(F.lit("p"), _s(k % 10)))).alias("item_property_list"),
        (k % 7).alias("item_brand_id"),
        (k % 11).alias("item_city_id"),
        (k % 14).cast("int").alias("item_price_level"),
        (k % 18).cast("int").alias("item_sales_level"),
        ((k + 5) % 18).cast("int").alias("item_collected_level"),
        (k % 22).cast("int").alias("item_pv_level"),
        u.alias("user_id"),
        (u % 3).cast("int").alias("user_gender_id"),
        (u % 9).cast("int").alias("user_age_level"),
        (u % 5).cast("int").alias("user_occupation_id"),
        (u % 12).cast("int").alias("user_star_level"),
        F.col("event_id").alias("context_id"),
        epoch_seconds("ts").alias("context_timestamp"),
        (F.col("event_id") % 20).cast("int").alias("context_page_id"),
        F.concat_ws(";",
                    F.concat(_s(k % 13), F.lit(":p"), _s(k % 10), F.lit(",p"), _s(k % 7 + 10)),
                    F.concat(_s((k + 1) % 13), F.lit(":-1")),
                    F.when(k % 6 == 0, F.lit("junk")),
                    F.concat(_s((k + 2) % 13), F.lit(":p"), _s((k + 3) % 10))).alias("predict_category_property"),
        (k % 20).alias("shop_id"),
        (k % 25).cast("int").alias("shop_review_num_level"),
        ((k + u) % 22).cast("int").alias("shop_star_level"),
        F.when(k % 9 == 0, F.lit(-1.0)).otherwise(v / 500.0).alias("shop_review_positive_rate"),
        ((k % 17) / 17.0).alias("shop_score_service"),
        ((u % 13) / 13.0).alias("shop_score_delivery"),
        (v / 1000.0).alias("shop_score_description"),
        (F.col("event_type") == "purchase").cast("int").alias("is_trade"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem ⋈ orders ⋈ part ⋈ supplier`` as a larger click log.

    user ``o_custkey``, item ``l_partkey``, shop ``l_suppkey``, brand
    ``p_brand``, city ``s_nationkey``, time ``o_orderdate``, label
    ``l_returnflag = 'R'``; ``(l_orderkey, l_linenumber)`` is *not* unique.
    The dimension joins are left to Catalyst/AQE (part/supplier are small
    dimension tables and get broadcast by size estimate; nothing is forced).
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey)
           .join(s, li.l_suppkey == s.s_suppkey))
    return j.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("shop_id"),
        F.col("p_brand").alias("item_brand_id"),
        F.col("s_nationkey").alias("item_city_id"),
        F.col("p_type"), F.col("p_size"),
        F.regexp_replace("p_name", " ", ";").alias("item_property_list"),
        epoch_seconds("o_orderdate").alias("context_timestamp"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_trade"),
    )


def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer ⋈ nation ⋈ region`` -> ``item_category_list`` strings ``a;b[;c]``.

    The third level is dropped for every fourth customer (missing level).
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    ck = F.col("c_custkey")
    return j.select(
        ck.alias("row_id"),
        F.concat_ws(";", _s(F.col("r_regionkey")), _s(F.col("n_nationkey")),
                    F.when(ck % 4 != 0, _s(ck % 13))).alias("item_category_list"))


def predict_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``predict_category_property`` string per order, built from its lines.

    Line token by ``l_linenumber % 4``: 0 -> ``type:-1``, 3 -> bare ``type``
    (no colon: skipped by the parser), else ``type:brand,Brand#(size%5)``.
    Tokens are joined in ``(l_linenumber, l_partkey)`` order; ties produce
    identical tokens, so the string is deterministic.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    ln = F.col("l_linenumber")
    tok = (F.when(ln % 4 == 0, F.concat("p_type", F.lit(":-1")))
            .when(ln % 4 == 3, F.col("p_type"))
            .otherwise(F.concat("p_type", F.lit(":"), "p_brand", F.lit(",Brand#"), _s(F.col("p_size") % 5))))
    # Ordered string per order: sort the (line, part, token) structs of the
    # group, then join; a partial aggregate only carries the group's own lines.
    g = (j.groupBy("l_orderkey")
          .agg(F.array_sort(F.collect_list(F.struct(ln.alias("ln"), F.col("l_partkey").alias("pk"), tok.alias("t"))))
               .alias("toks")))
    return g.select(F.col("l_orderkey").alias("row_id"),
                    F.array_join(F.transform("toks", lambda x: x["t"]), ";").alias("predict_category_property"))
