"""Per-group order features and sizes of many scopes over one exchange
(W1, W2, W4, W5, and the user groupings of G2-G7).

Every scope contains an anchor key (the user), so a frame dealt out by the
anchor serves all of them.  An anchor with more than ``chunk_rows`` rows (the
NULL anchor included) is cut into chunks: its rows are range-partitioned on
(anchor, time, row key) and the partition number, written to the shared folder,
is the chunk.  All order features are taken inside (anchor, chunk), with numpy over
rows that Spark has dealt out and sorted.  A small summary - rows,
first and last time of each scope group in each chunk - then carries counts
and neighbouring times from chunk to chunk by running aggregates, and is joined
back on (scope keys, chunk).  An anchor that is not cut has one chunk, so its
rows need no summary; the formula is the same.

NULL keys group together, NULL times come first.  Keys are single values of any
type; the order of the rows is Spark's, whatever the time's and row key's types.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from clickfeat.session import scratch_path

# Rows of one anchor that one task sorts and holds at once.
CHUNK_ROWS = 500_000
# Rows that a task takes off its sorted rows at a time (more for a larger anchor), and hands on.
BATCH_ROWS, OUT_ROWS = 1 << 16, 1 << 13

ORDER = ("rn", "prev", "next", "n", "first", "last")


def _same(a: DataFrame, b: DataFrame, keys) -> list:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by ``keys`` into ``spark.sql.shuffle.partitions``: the many windows that
    follow cost far more than their bytes suggest, so the partitions are not to
    be merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def split_anchors(df: DataFrame, anchor: str, ts: str, key: str, chunk_rows: int):
    """``(rows of ordinary anchors, rows of cut anchors with their __chunk or None)``."""
    sizes = df.groupBy(anchor).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > chunk_rows)
    total = sizes.agg(F.sum("__rows")).first()[0]
    if not total:
        return df, None
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "cut-anchors")
    sizes.select(anchor).write.parquet(path)
    cut = spark.read.schema(sizes.select(anchor).schema).parquet(path)
    rows, path = df.join(cut, _same(df, cut, [anchor]), "left_semi"), scratch_path(spark, "chunks")
    (rows.repartitionByRange(int(total // max(1, chunk_rows)) + 1, anchor, ts, key)
         .withColumn("__chunk", F.spark_partition_id()).write.parquet(path))
    chunked = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__chunk", T.IntegerType())])).parquet(path)
    return df.join(cut, _same(df, cut, [anchor]), "left_anti"), chunked


def _local(df: DataFrame, specs, ts, key, extra, anchor):
    """The order features of rows dealt by ``anchor`` (and ``extra``).  One sort by
    (anchor, time, row key) serves all scopes: a task takes whole anchors off its
    sorted rows and groups them by codes of the scopes' keys; a window for each
    scope would sort the rows once more for each."""
    rows = df.sortWithinPartitions(anchor, *extra, ts, key)
    kinds = {"rn": T.LongType(), "n": T.LongType()}
    more = [T.StructField(f"{name}__{c}", kinds.get(c, df.schema[ts].dataType)) for name, (_, wanted) in specs.items() for c in wanted]
    return rows.mapInArrow(_scoped(specs, ts, [anchor, *extra]), T.StructType([*df.schema.fields, *more]))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values, NULLs included, have equal codes from 0 on."""
    if pa.types.is_floating(column.type):  # 0.0 and -0.0 are one value
        column = pc.add(column, pa.scalar(0.0, column.type))
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _groups(parts: list[np.ndarray]) -> np.ndarray:
    """One code for each combination of the parts' codes."""
    out, size = parts[0].astype(np.int64), int(parts[0].max()) + 1
    for p in parts[1:]:
        n = int(p.max()) + 1
        if size * n >= 1 << 62:
            found, out = np.unique(out, return_inverse=True)
            size = len(found)
        out, size = out * n + p, size * n
    return out


def _features(t: pa.Table, specs, ts, alone: np.ndarray) -> list[pa.Array]:
    """The columns of ``specs`` for whole anchors in order (``alone``: the anchor's code)."""
    n, at = t.num_rows, t.column(ts).combine_chunks()
    timed = at.is_valid().to_numpy(zero_copy_only=False)
    codes, scopes, out = {}, {}, []
    for keys, wanted in specs.values():
        scope = tuple(sorted(keys))
        if scope not in scopes:
            for k in scope:
                if k not in codes:
                    codes[k] = _codes(t.column(k))
            group = _groups([alone, *[codes[k] for k in scope]])
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order])) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
            size = end - begin
            scopes[scope] = order, begin, end, size, np.arange(n) - np.repeat(begin, size)
        order, begin, end, size, place = scopes[scope]

        def back(values, there=None):
            """Values in the groups' order put back to the rows; with ``there`` places of times."""
            own = np.empty(n, np.int64)
            own[order] = values
            if there is None:
                return pa.array(own)
            some = np.empty(n, bool)
            some[order] = there
            return at.take(pa.array(own, mask=~some))
        for w in wanted:
            if w == "rn":
                out.append(back(place + 1))
            elif w == "n":
                out.append(back(np.repeat(size, size)))
            elif w == "prev":
                out.append(back(np.concatenate([[0], order[:-1]]), place > 0))
            elif w == "next":
                out.append(back(np.concatenate([order[1:], [0]]), place < np.repeat(size, size) - 1))
            elif w == "last":  # NULL times come first: NULL only if all are
                out.append(back(np.repeat(order[end - 1], size), np.ones(n, bool)))
            else:  # the first time that is not NULL
                untimed = np.add.reduceat((~timed[order]).astype(np.int64), begin)
                first = order[np.minimum(begin + untimed, end - 1)]
                out.append(back(np.repeat(first, size), np.ones(n, bool)))
    return out


def _scoped(specs, ts, together):
    """Rows sorted by ``together`` to rows with the columns of ``specs``: whole groups
    of ``together`` at a time, some ``BATCH_ROWS`` rows."""
    def run(batches):
        held, rows, least = [], 0, BATCH_ROWS

        def done(t, code):
            columns = [*t.columns, *_features(t, specs, ts, code)]
            names = [*t.schema.names, *[f"{name}__{c}" for name, (_, wanted) in specs.items() for c in wanted]]
            for b in pa.table(columns, names=names).to_batches(max_chunksize=OUT_ROWS):
                yield b

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < least:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            code = _groups([_codes(t.column(c)) for c in together])
            other = np.flatnonzero(code != code[-1])
            if len(other):  # the last group may go on
                upto = int(other[-1]) + 1
                yield from done(t.slice(0, upto), code[:upto])
                held, rows, least = t.slice(upto).to_batches(), t.num_rows - upto, BATCH_ROWS
            least = max(least, 2 * rows)
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from done(t, _groups([_codes(t.column(c)) for c in together]))
    return run


def _carried(chunked: DataFrame, keys, ts, key):
    """Of every scope group and chunk: rows and last time before it, first time
    after it, and the whole group's size, first and last time."""
    at = F.struct(ts, key)
    s = chunked.groupBy(*keys, "__chunk").agg(
        F.count(F.lit(1)).alias("c"), F.min(ts).alias("lo"), F.max(ts).alias("hi"),
        F.min_by(ts, at).alias("head"), F.max_by(ts, at).alias("tail"))
    group = Window.partitionBy(*keys)
    w = group.orderBy("__chunk")
    before = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return s.select(*keys, "__chunk", F.coalesce(before, F.lit(0)).alias("__before"), F.col("c").alias("__here"),
                    F.lag("tail").over(w).alias("__prev"), F.lead("head").over(w).alias("__next"),
                    F.sum("c").over(group).cast("bigint").alias("__n"), F.min("lo").over(group).alias("__first"),
                    F.max("hi").over(group).alias("__last"))


def add_scopes(df: DataFrame, specs: dict[str, tuple[list[str], tuple]], ts: str = "context_timestamp",
               key: str = "instance_id", anchor: str = "user_id", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``df`` and a column ``{name}__{what}`` for each spec ``name -> (scope keys,
    what)``; ``what`` out of ``ORDER``: ordinal, previous and next time, size, first
    and last time of the row's group.  Every scope must contain ``anchor``;
    ``chunk_rows=None`` cuts no anchor."""
    if not specs:
        return df
    if any(anchor not in keys for keys, _ in specs.values()):
        raise ValueError(f"every scope must contain {anchor}")
    plain, chunked = (df, None) if chunk_rows is None else split_anchors(df, anchor, ts, key, chunk_rows)
    out = _local(dealt(plain, anchor), specs, ts, key, [], anchor)
    if chunked is None:
        return out
    inner = {n: (k, tuple(dict.fromkeys([*w, *(["rn", "n"] if {"rn", "prev", "next"} & set(w) else [])]))) for n, (k, w) in specs.items()}
    hot = _local(dealt(chunked, anchor, "__chunk"), inner, ts, key, ["__chunk"], anchor)
    for name, (keys, wanted) in specs.items():
        tag = uuid.uuid4().hex[:6]
        s = _carried(chunked, keys, ts, key)
        s = s.select(*[F.col(c).alias(f"{tag}{c}") for c in s.columns])
        on = [hot[k].eqNullSafe(s[tag + k]) for k in keys] + [hot["__chunk"] == s[f"{tag}__chunk"]]
        rn = F.col(f"{name}__rn") if "rn" in inner[name][1] else None
        new = {"rn": lambda: rn + F.col(f"{tag}__before"),
               "prev": lambda: F.when(rn == 1, F.col(f"{tag}__prev")).otherwise(F.col(f"{name}__prev")),
               "next": lambda: F.when(rn == F.col(f"{tag}__here"), F.col(f"{tag}__next")).otherwise(F.col(f"{name}__next")),
               "n": lambda: F.col(f"{tag}__n"), "first": lambda: F.col(f"{tag}__first"), "last": lambda: F.col(f"{tag}__last")}
        kept = [c for c in hot.columns if not c.startswith(f"{name}__")]
        hot = hot.join(s, on, "left").select(*[hot[c] for c in kept], *[new[c]().alias(f"{name}__{c}") for c in wanted])
    return out.unionByName(hot.select(*out.columns))


def ordered_features(df: DataFrame, keys: list[str], ts: str = "context_timestamp", key: str = "instance_id",
                     max_group_rows: int | None = CHUNK_ROWS, anchor: str | None = None) -> DataFrame:
    """``key, value, rn, prev_ts, next_ts, n, first_ts, last_ts`` of one scope
    (``value`` is the row's ordering value ``ts``)."""
    o = add_scopes(df, {"o": (list(keys), ORDER)}, ts, key, anchor or keys[0], max_group_rows)
    names = ("rn", "prev_ts", "next_ts", "n", "first_ts", "last_ts")
    return o.select(key, F.col(ts).alias("value"), *[F.col(f"o__{a}").alias(b) for a, b in zip(ORDER, names)])


def recent_counts(df: DataFrame, keys: list[str], seconds: int, ts: str = "context_timestamp",
                  key: str = "instance_id", name: str = "recent", **kw) -> DataFrame:
    """Rows of the row's group with time in ``[t - seconds, t]`` (a RANGE frame,
    ties included; a NULL time counts its group's NULL times) without a window
    over the group: ``key, name``.

    Rows are merged with query points in one order per bound and ranks are
    read: with values ``2t+1`` for rows and ``2(t-w)`` for queries, a query's rank
    minus its rank among queries (its ordinal) counts rows with time ``< t-w``;
    with ``2t`` for rows and ``2t+1`` for queries it counts rows with time
    ``<= t``.  The ordinals cancel, so the count is the difference of the two
    merged ranks.
    """
    base = df.select(key, *keys, F.col(ts).cast("bigint").alias("__t"))
    t, timed = F.col("__t"), base.where("__t is not null")

    def merged(data_v, query_v, query_parity):
        u = timed.select(key, *keys, data_v.alias("__v")).unionByName(timed.select(key, *keys, query_v.alias("__v")))
        o = ordered_features(u, keys, "__v", key, **kw)
        return o.where(F.pmod(F.col("value"), F.lit(2)) == query_parity).select(key, "rn")

    lower = merged(t * 2 + 1, (t - seconds) * 2, 0).withColumnRenamed("rn", "__lo")
    upper = merged(t * 2, t * 2 + 1, 1).withColumnRenamed("rn", "__hi")
    found = lower.join(upper, key).select(key, (F.col("__hi") - F.col("__lo")).cast("bigint").alias(name))
    untimed = base.where("__t is null")
    size = untimed.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return found.unionByName(untimed.join(size, _same(untimed, size, keys)).select(key, name))
