"""DuckDB twins of the stand-in logs (``clickfeat.sources.standin``).

Each oracle query is ``WITH <stand-in CTEs> <body>``; the driver runs it on
DuckDB views of the same parquet files.  Integer outputs are cast to BIGINT
and inexact doubles rounded on both sides.
"""

EVENTS_LOG = """
ev0 AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
  FROM events),
log AS (
  SELECT event_id AS instance_id,
         k AS item_id,
         concat_ws(';', '1', CAST(k % 13 AS VARCHAR), CASE WHEN k % 4 <> 0 THEN CAST(k % 3 AS VARCHAR) END) AS item_category_list,
         concat_ws(';', 'p' || CAST(k % 10 AS VARCHAR), 'p' || CAST(k % 7 + 10 AS VARCHAR),
                   'p' || CAST((k + user_id) % 5 + 20 AS VARCHAR),
                   CASE WHEN k % 5 = 0 THEN 'p' || CAST(k % 10 AS VARCHAR) END) AS item_property_list,
         k % 7 AS item_brand_id,
         k % 11 AS item_city_id,
         CAST(k % 14 AS INTEGER) AS item_price_level,
         CAST(k % 18 AS INTEGER) AS item_sales_level,
         CAST((k + 5) % 18 AS INTEGER) AS item_collected_level,
         CAST(k % 22 AS INTEGER) AS item_pv_level,
         user_id,
         CAST(user_id % 3 AS INTEGER) AS user_gender_id,
         CAST(user_id % 9 AS INTEGER) AS user_age_level,
         CAST(user_id % 5 AS INTEGER) AS user_occupation_id,
         CAST(user_id % 12 AS INTEGER) AS user_star_level,
         event_id AS context_id,
         CAST(floor(epoch(ts)) AS BIGINT) AS context_timestamp,
         CAST(event_id % 20 AS INTEGER) AS context_page_id,
         concat_ws(';',
           CAST(k % 13 AS VARCHAR) || ':p' || CAST(k % 10 AS VARCHAR) || ',p' || CAST(k % 7 + 10 AS VARCHAR),
           CAST((k + 1) % 13 AS VARCHAR) || ':-1',
           CASE WHEN k % 6 = 0 THEN 'junk' END,
           CAST((k + 2) % 13 AS VARCHAR) || ':p' || CAST((k + 3) % 10 AS VARCHAR)) AS predict_category_property,
         k % 20 AS shop_id,
         CAST(k % 25 AS INTEGER) AS shop_review_num_level,
         CAST((k + user_id) % 22 AS INTEGER) AS shop_star_level,
         CASE WHEN k % 9 = 0 THEN -1.0 ELSE value / 500.0 END AS shop_review_positive_rate,
         (k % 17) / 17.0 AS shop_score_service,
         (user_id % 13) / 13.0 AS shop_score_delivery,
         value / 1000.0 AS shop_score_description,
         CAST(event_type = 'purchase' AS INTEGER) AS is_trade
  FROM ev0),
tlog AS (
  SELECT *,
         strftime(make_timestamp(context_timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS time,
         CAST(isodow(make_timestamp(context_timestamp * 1000000)) >= 6 AS INTEGER) AS is_week,
         CAST(day(make_timestamp(context_timestamp * 1000000)) AS INTEGER) AS day,
         CAST(hour(make_timestamp(context_timestamp * 1000000)) AS INTEGER) AS hour,
         CAST(minute(make_timestamp(context_timestamp * 1000000)) AS INTEGER) AS minute,
         CAST(hour(make_timestamp(context_timestamp * 1000000)) * 2
              + CASE WHEN minute(make_timestamp(context_timestamp * 1000000)) >= 30 THEN 1 ELSE 0 END AS INTEGER) AS half_hour
  FROM log),
flog AS (
  SELECT *,
         CAST(string_split(item_category_list, ';')[1] AS BIGINT) AS category_0,
         CAST(string_split(item_category_list, ';')[2] AS BIGINT) AS category_1,
         CAST(coalesce(string_split(item_category_list, ';')[3], '-1') AS BIGINT) AS category_2
  FROM tlog)"""

ORDER_LOG = """
olog AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_shipdate,
         o.o_custkey AS user_id, l.l_partkey AS item_id, l.l_suppkey AS shop_id,
         p.p_brand AS item_brand_id, s.s_nationkey AS item_city_id, p.p_type, p.p_size,
         replace(p.p_name, ' ', ';') AS item_property_list,
         CAST(floor(epoch(o.o_orderdate)) AS BIGINT) AS context_timestamp,
         CAST(l.l_returnflag = 'R' AS INTEGER) AS is_trade
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN part p ON l.l_partkey = p.p_partkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

CATEGORY_PATHS = """
cpath AS (
  SELECT c.c_custkey AS row_id,
         concat_ws(';', CAST(r.r_regionkey AS VARCHAR), CAST(n.n_nationkey AS VARCHAR),
                   CASE WHEN c.c_custkey % 4 <> 0 THEN CAST(c.c_custkey % 13 AS VARCHAR) END) AS item_category_list
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

PREDICT_STRINGS = """
pstr AS (
  SELECT l.l_orderkey AS row_id,
         string_agg(CASE WHEN l.l_linenumber % 4 = 0 THEN p.p_type || ':-1'
                         WHEN l.l_linenumber % 4 = 3 THEN p.p_type
                         ELSE p.p_type || ':' || p.p_brand || ',Brand#' || CAST(p.p_size % 5 AS VARCHAR) END,
                    ';' ORDER BY l.l_linenumber, l.l_partkey) AS predict_category_property
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
