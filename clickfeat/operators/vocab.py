"""Top-k vocabularies of multi-valued columns and row membership.

Counting (V*): every occurrence counts, duplicates inside a row included.
Membership (A*): by set.  Ties in the top-k break by token so results are
deterministic (the reference's ``Counter.most_common`` order is arbitrary).

A vocabulary has at most ``k`` entries (k <= a few thousand in the
reference), so it is brought to the driver - a proven size bound - and
embedded as a literal array: membership tests then run inside whole-stage
codegen with no join at all.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickfeat.operators.encode import staged
from clickfeat.session import scratch_path


def topk_tokens(df: DataFrame, tokens_col, k: int, positives_only: bool = False,
                label: str = "is_trade") -> DataFrame:
    """``(token, cnt, rnk)`` of the ``k`` most frequent tokens (rnk 0-based).

    ``explode -> groupBy.count`` (map-side combine: a token present in a third
    of all rows is one row per task) ``-> orderBy.limit`` (per-partition top-k,
    then a k-row merge).
    """
    src = df.where(F.col(label) == 1) if positives_only else df
    col = F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col
    counts = src.select(F.explode(col).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).cast("bigint").alias("cnt"))
    top = counts.orderBy(F.col("cnt").desc(), F.col("token")).limit(k)
    return top


def vocabularies(df: DataFrame, specs: dict, label: str = "is_trade") -> dict[str, list[str]]:
    """Several top-k vocabularies in one aggregation.

    ``specs``: name -> (token array column, k, positives_only).  All token
    lists are exploded with their name, counted in one ``groupBy(name,
    token)`` (map-side combine), written once, and every name's k best are a
    top-k of its counts.
    """
    if not specs:
        return {}
    c = _exploded(df, specs, label).groupBy("v", "token").agg(F.count(F.lit(1)).alias("cnt"))
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "token-counts")
    c.write.parquet(path)
    c = spark.read.schema(c.schema).parquet(path)
    # k best per task, then a k-row merge: no task ranks all tokens of a list
    return {n: vocabulary(c.where(F.col("v") == n).orderBy(F.col("cnt").desc(), F.col("token")).limit(k))
            for n, (_c, k, _p) in specs.items()}


def _exploded(df: DataFrame, specs: dict, label: str) -> DataFrame:
    """``(v, token)``: every occurrence in every list."""
    parts = []
    for name, (col, _k, pos) in specs.items():
        arr = F.when(F.col(label) == 1, col) if pos else col
        parts.append(F.struct(F.lit(name).alias("v"), arr.alias("t")))
    return df.select(F.explode(F.array(*parts)).alias("s")).select("s.v", F.explode("s.t").alias("token"))


def heavy_tokens(df: DataFrame, specs: dict, label: str = "is_trade", per_k: int = 64) -> DataFrame:
    """V1-V4 over unbounded token domains: ``(v, token, cnt, rnk, others_below,
    counted)``, the exact top-k of every list of ``specs`` (as ``vocabularies``)
    without a shuffle of all distinct tokens.

    1. Sketch: occurrences by bucket of two hashes, at most ``2 * buckets`` rows a
       list and task however many tokens there are.  Sketches add up, and no token
       occurs more often than either of its buckets.
    2. Only tokens whose two buckets both reach a threshold are counted exactly, at
       first that of the ``2k``-th largest bucket.
    3. Certificate: a token not counted occurs less often than the threshold
       (``others_below``), so the result is certain once the k-th count reaches it.
       If it does not, the k-th count is a threshold that is certain: one more pass.
       Flat data come down to counting all tokens, as does a list of fewer than
       ``k``; ``counted`` is the number of distinct tokens counted exactly.

    NULL tokens count as a token, empty and NULL arrays as nothing.
    """
    buckets = 1 << max(10, (per_k * max(k for _c, k, _p in specs.values()) - 1).bit_length())
    hashes = [F.pmod(F.xxhash64("token", F.lit(i)), F.lit(buckets)).cast("int") for i in (0, 1)]
    long = _exploded(df, specs, label)
    cells = F.array(*[F.struct(F.lit(i).alias("h"), x.alias("bucket")) for i, x in enumerate(hashes)])
    sketch = staged(long.select("v", F.explode(cells).alias("c")).groupBy("v", "c.h", "c.bucket").agg(F.count(F.lit(1)).alias("n")),
                    "token-sketch")
    wanted = {v: k for v, (_c, k, _p) in specs.items()}
    # at most ``buckets`` rows a list are ranked; one row a list comes back
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.col("n").desc()))
    at = sketch.where("h = 0").withColumn("place", place).where(F.col("place") == _by_list({v: 2 * k for v, k in wanted.items()}))
    least = {v: 0 for v in wanted} | {r["v"]: r["n"] for r in at.collect()}
    done, open_ = [], list(wanted)
    while open_:
        heavy = sketch.where(F.col("v").isin(open_) & (F.col("n") >= _by_list({v: least[v] for v in open_})))
        some = long.where(F.col("v").isin(open_))
        for i, x in enumerate(hashes):  # at most ``buckets`` rows a list are broadcast
            some = (some.withColumn("bucket", x)
                        .join(F.broadcast(heavy.where(F.col("h") == i).select("v", "bucket")), ["v", "bucket"], "left_semi"))
        counts = staged(some.groupBy("v", "token").agg(F.count(F.lit(1)).alias("cnt")), "token-counts")
        tops = [counts.where(F.col("v") == v).orderBy(F.col("cnt").desc(), F.col("token")).limit(wanted[v]) for v in open_]
        top = staged(reduce(DataFrame.unionByName, tops), "token-top")
        found = {r["v"]: r for r in top.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("cnt").alias("kth")).collect()}
        certain = [v for v in open_ if not least[v] or (v in found and found[v]["c"] == wanted[v] and found[v]["kth"] >= least[v])]
        if certain:
            size = counts.groupBy("v").agg(F.count(F.lit(1)).alias("counted"))  # one row a list
            rank = F.row_number().over(Window.partitionBy("v").orderBy(F.col("cnt").desc(), F.col("token")))  # k rows
            done.append(top.where(F.col("v").isin(certain)).join(F.broadcast(size), "v")
                           .select("v", "token", "cnt", (rank - 1).cast("bigint").alias("rnk"),
                                   _by_list({v: least[v] for v in certain}).alias("others_below"), "counted"))
        open_ = [v for v in open_ if v not in certain]
        for v in open_:
            full = v in found and found[v]["c"] == wanted[v]
            least[v] = found[v]["kth"] if full else 0
    return reduce(DataFrame.unionByName, done)


def _by_list(of: dict) -> Column:
    """A number of each list, by its name in ``v``."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("v")).cast("bigint")


def vocabulary(top: DataFrame) -> list[str]:
    """Tokens of a top-k frame in rank order (bounded by k)."""
    rows = top.collect()
    return [r["token"] for r in sorted(rows, key=lambda r: (-r["cnt"], r["token"]))]


def _lit_array(vocab: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in vocab]).cast("array<string>")


def _members(tokens: Column, vocab: list[str]) -> Column:
    """The row's distinct vocabulary tokens.  ``isin`` over constants is a constant
    hash set, built once a task, so the cost of a row does not depend on the
    vocabulary's size."""
    if not vocab:
        return F.array().cast("array<string>")
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(vocab)))


def overlap_count(tokens: Column, vocab: list[str]) -> Column:
    """A5: size of (row token set ∩ vocabulary)."""
    return F.size(_members(tokens, vocab))


def overlap_string(tokens: Column, vocab: list[str], sep: str = ";") -> Column:
    """The intersection, sorted, joined (encode it with ``first_seen_codes``)."""
    return F.array_join(F.array_sort(_members(tokens, vocab)), sep)


def overlap_ranks(tokens: Column, vocab: list[str]) -> Column:
    """Ascending 0-based ranks of the row's vocabulary tokens.  The vocabulary is
    cut into buckets by the token's hash, so a rank is looked for among a few
    tokens only."""
    if not vocab:
        return F.array().cast("array<int>")
    n = max(1, len(vocab) // 4)
    buckets: list[list] = [[] for _ in range(n)]
    for rank, token in enumerate(vocab):
        buckets[zlib.crc32(token.encode()) % n].append((token, rank))
    tokens_of = F.array(*[_lit_array([t for t, _ in b]) for b in buckets])
    ranks_of = F.array(*[F.array(*[F.lit(r) for _, r in b]).cast("array<int>") for b in buckets])

    def rank(t):
        k = (F.crc32(t.cast("binary")) % n + 1).cast("int")
        return F.element_at(F.element_at(ranks_of, k), F.array_position(F.element_at(tokens_of, k), t).cast("int"))
    return F.array_sort(F.transform(_members(tokens, vocab), rank))


def multi_hot(tokens: Column, vocab: list[str], prefix: str, width: int | None = None) -> list[Column]:
    """``prefix_j = 1`` iff the row contains vocabulary token j.

    ``width`` columns are produced (default ``len(vocab)``); columns past the
    vocabulary stay 0, as the reference's zero matrix.
    """
    width = len(vocab) if width is None else width
    cols = []
    for j in range(width):
        if j < len(vocab):
            cols.append(F.array_contains(tokens, F.lit(vocab[j])).cast("int").alias(f"{prefix}_{j}"))
        else:
            cols.append(F.lit(0).alias(f"{prefix}_{j}"))
    return cols
