"""Explicit schemas: never inferred (the reference's inference turned label
histories like ``0010`` into numbers)."""

from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

RAW_LOG = T.StructType([
    T.StructField("instance_id", L), T.StructField("item_id", L), T.StructField("item_category_list", S),
    T.StructField("item_property_list", S), T.StructField("item_brand_id", L), T.StructField("item_city_id", L),
    T.StructField("item_price_level", I), T.StructField("item_sales_level", I),
    T.StructField("item_collected_level", I), T.StructField("item_pv_level", I),
    T.StructField("user_id", L), T.StructField("user_gender_id", I), T.StructField("user_age_level", I),
    T.StructField("user_occupation_id", I), T.StructField("user_star_level", I),
    T.StructField("context_id", L), T.StructField("context_timestamp", L), T.StructField("context_page_id", I),
    T.StructField("predict_category_property", S), T.StructField("shop_id", L),
    T.StructField("shop_review_num_level", I), T.StructField("shop_star_level", I),
    T.StructField("shop_review_positive_rate", D), T.StructField("shop_score_service", D),
    T.StructField("shop_score_delivery", D), T.StructField("shop_score_description", D),
    T.StructField("is_trade", I),
])

PREDICTIONS = T.StructType([T.StructField("instance_id", L), T.StructField("is_trade", I),
                            T.StructField("predicted_score", D)])

FREQ_TABLE = T.StructType([T.StructField("Field", S), T.StructField("Value", S), T.StructField("Neg", L),
                           T.StructField("Pos", L), T.StructField("Total", L), T.StructField("Ratio", D)])
