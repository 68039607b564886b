"""clickfeat: a Spark-native click-log feature engine.

Turns an ad impression/click log with a 0/1 conversion label into row-level
features (group sizes, time gaps, label histories, ordinals, prior-purchase
flags, smoothed rates, list/vocabulary indicators, encodings), writes
sparse field-aware text rows, trains/scores with ``pyspark.ml`` and
evaluates/blends score tables.  Every operator is a DataFrame -> DataFrame
function built from native Spark expressions; column names are arguments.
"""

__version__ = "0.1.0"
