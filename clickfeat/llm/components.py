"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014).

Every step is one aggregate (partial sums before the shuffle) and one join on
the node, so a hub's edges are split by the skew join; edges stay linear in the
input and never reach the driver.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickfeat.llm.common import staged


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _linked(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _linked(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def _state(e: DataFrame):
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges (u long, v long)`` -> ``(node, root)`` for every node that has an
    edge; ``root`` is the smallest node it reaches.  Loops, repeated and
    reversed edges are fine; nulls are not edges."""
    e = staged(_linked(edges.where("u is not null and v is not null").select("u", "v")), "edges")
    before = _state(e)
    while before[0]:
        e = staged(_small_star(_large_star(e)), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
