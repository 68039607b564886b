"""Encoders, bucketing and scaling."""

from __future__ import annotations

from contextlib import nullcontext

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickfeat.session import compiled, scratch_path

# A code table is broadcast up to so many measured bytes.
BROADCAST_BYTES = 16 << 20
# The codes of a column with at most so many values are written into the plan.
LITERAL_CODES = 128
# Integers of such a range are looked up by place.
LITERAL_RANGE = 4096
_POS_BITS = 33  # monotonically_increasing_id: partition index << 33 | row position


def staged(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """The rows written once to the shared scratch folder and read back; ``wide``: by a
    plan of many expressions (``session.compiled``)."""
    path = scratch_path(df.sparkSession, name)
    with compiled(df.sparkSession) if wide else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def consecutive_index(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """Number the rows 1..n in ``order`` without a single-partition window.

    ``orderBy`` range-partitions and sorts in parallel; within a partition
    ``monotonically_increasing_id`` is ``pid << 33 | position``; the rows
    before every partition are joined on the partition number.  The sorted frame
    is written to the shared folder first so both passes see the same
    partitioning.
    """
    s = staged(df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("__mid")), "sorted")
    pid = F.shiftright(F.col("__mid"), _POS_BITS)
    # rows before each partition: one row a partition
    sizes = s.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__pid", F.coalesce(before, F.lit(0)).alias("__before"))
    pos = F.col("__mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    return (s.withColumn("__pid", pid).join(sizes, "__pid")
             .select(*[c for c in s.columns if c != "__mid"], (F.col("__before") + pos + 1).cast("bigint").alias(name)))


def value_table(pop: DataFrame, cols: list[str], order: list[str], label: str | None = None) -> DataFrame:
    """The distinct values of every column, in one pass: ``(g, v, first)`` - column
    position, value as string (NULL kept as a value), least ``order`` - and with
    ``label`` its rows ``Neg`` and ``Pos``.

    One unpivot -> one ``groupBy(g, v)`` (partial aggregation: a value holding a
    third of the rows is one row per task), written to the shared folder.
    """
    args = ", ".join(f"{i}, CAST(`{c}` AS STRING)" for i, c in enumerate(cols))
    long = pop.select(_one_order(pop, order).alias("__o"), *([F.col(label).alias("__y")] if label else []),
                      F.expr(f"stack({len(cols)}, {args}) AS (g, v)"))
    counts = []
    if label:
        counts = [F.sum(F.when(F.col("__y") == 1, 0).otherwise(1)).cast("bigint").alias("Neg"),
                  F.sum(F.when(F.col("__y") == 1, 1).otherwise(0)).cast("bigint").alias("Pos")]
    return staged(long.groupBy("g", "v").agg(F.min("__o").alias("first"), *counts), "values")


def _one_order(df: DataFrame, order: list[str]) -> Column:
    """``order`` as one value.  The least struct of a group is found by sorting, the
    least decimal by hashing, so up to two integers become a decimal (NULL first);
    the first of two must be below 10^18, which overflow would report."""
    kinds = dict(df.dtypes)
    if len(order) > 2 or any(kinds.get(o) not in ("tinyint", "smallint", "int", "bigint") for o in order):
        return F.struct(*[F.col(o) for o in order])
    above = 1 << 63  # 64-bit integers from 1 on, 0 for NULL
    place = [F.coalesce(F.col(o).cast("decimal(20,0)") + F.lit(str(above + 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)")) for o in order]
    if len(place) == 1:
        return place[0].cast("decimal(38,0)")
    # times are small: 18 digits; the second takes 20
    head = F.coalesce(F.col(order[0]).cast("decimal(18,0)"), F.lit("-" + "9" * 18).cast("decimal(18,0)"))
    return (head * F.lit("1" + "0" * 20).cast("decimal(21,0)") + place[1]).cast("decimal(38,0)")


def _sizes(values: DataFrame) -> dict:
    """Number of values and bytes of the codes of every column."""
    width = F.coalesce(F.octet_length("v"), F.lit(0)) + F.lit(24)
    return {r["g"]: r for r in values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).collect()}


def numbered_values(values: DataFrame, sizes: dict | None = None) -> DataFrame:
    """``code``: the place of every value in the first-appearance order of its
    column.  The values of a column of up to ``BROADCAST_BYTES`` (measured) are
    ranked in one task; those of the others by one distributed numbering over
    ``(g, first)``, a column's codes being its numbers minus the column's first."""
    sizes = _sizes(values) if sizes is None else sizes
    wide = [g for g, r in sizes.items() if r["b"] > BROADCAST_BYTES]
    rank = F.row_number().over(Window.partitionBy("g").orderBy("first")).cast("bigint")
    near = values.where(~F.col("g").isin(wide) if wide else F.lit(True)).withColumn("code", rank)
    if not wide:
        return near
    num = consecutive_index(values.where(F.col("g").isin(wide)), ["g", "first"], "__idx")
    start = {r["g"]: r["s"] for r in num.groupBy("g").agg(F.min("__idx").alias("s")).collect()}
    m = F.create_map(*[x for g, st in start.items() for x in (F.lit(g), F.lit(st))])
    return near.unionByName(num.withColumn("code", (F.col("__idx") - F.element_at(m, F.col("g")) + 1).cast("bigint")).drop("__idx"))


def in_place(values) -> bool:
    """Whether integers (or their texts) are near enough to be places of a constant array."""
    whole = [int(v) for v in values]
    return bool(whole) and max(whole) - min(whole) < LITERAL_RANGE


def by_place(c: Column, numbers: dict[int, int]) -> Column:
    """The number (above 0) of an integer, by place in a constant array; NULL for others."""
    low, high = min(numbers), max(numbers)
    table = np.zeros(high - low + 1, np.int64)
    for v, n in numbers.items():
        table[v - low] = n
    own = F.when(c.between(low, high), (c.cast("bigint") - low).cast("int"))
    return F.nullif(F.get(F.lit(table), own), F.lit(0).cast("bigint"))


def _looked_up(column: str, kind: str, codes: dict) -> Column:
    """``column``'s code by a constant inside the projection: an array that an integer of a narrow
    range is a place of, else a map, which is searched entry by entry."""
    exact, c = kind in ("tinyint", "smallint", "int", "bigint"), F.col(column)
    known = [(v, n) for v, n in codes.items() if v is not None]
    found = F.lit(None).cast("bigint")
    if known and exact and in_place(v for v, _ in known):
        found = by_place(c, {int(v): n for v, n in known})
    elif known and exact:
        found = F.element_at(F.expr("map(" + ", ".join(f"{v}L, {n}L" for v, n in known) + ")"), c.cast("bigint"))
    elif known:
        found = F.element_at(F.create_map(*[F.lit(x) for pair in known for x in pair]), c.cast("string")).cast("bigint")
    return F.when(c.isNull(), F.lit(codes.get(None)).cast("bigint")).otherwise(found)


def first_seen_codes(df: DataFrame, cols: list[str], order: list[str], suffix: str = "",
                     population: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """E1 (and E2 with ``population`` = train ∪ test): values -> 1..n by first
    appearance in ``order``; NULL is a value and gets its own code.

    All columns share one distinct-value pass (``value_table``, or the one given).
    Columns of at most ``LITERAL_CODES`` values - most are levels - are looked up
    in constant maps in one projection.  The others share one numbering, and
    each is joined null-safely, broadcast where the measured bytes of its codes
    allow it.
    """
    if not cols:
        return df
    values = value_table(df if population is None else population, cols, order) if values is None else values
    sizes = _sizes(values)
    small = [g for g in range(len(cols)) if g not in sizes or sizes[g]["n"] <= LITERAL_CODES]
    of = {g: {} for g in small}
    if small:  # at most LITERAL_CODES rows a column
        few = values.where(F.col("g").isin(small)).select("g", "v", "first")
        for r in numbered_values(few, {g: r for g, r in sizes.items() if g in of}).collect():
            of[r["g"]][r["v"]] = r["code"]
    left = {g: r for g, r in sizes.items() if g not in of}
    codes = numbered_values(values.where(F.col("g").isin(list(left))).select("g", "v", "first"), left).drop("first") if left else None
    out, code, kinds = df, {}, dict(df.dtypes)
    for i, c in enumerate(cols):
        if i in of:
            code[c] = _looked_up(c, kinds[c], of[i])
            continue
        t = codes.where(F.col("g") == i).select(F.col("v").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
        if sizes[i]["b"] <= BROADCAST_BYTES:
            t = F.broadcast(t)
        out = out.join(t, F.col(c).cast("string").eqNullSafe(F.col(f"__v{i}")), "left")
        code[c] = F.col(f"__c{i}")
    if suffix:
        return out.select(*df.columns, *[code[c].alias(f"{c}{suffix}") for c in cols])
    return out.select(*[code[c].alias(c) if c in code else F.col(c) for c in df.columns])


def extended_codes(codes: DataFrame | None, more: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """E1/E2 as a dictionary that grows: ``codes (field, v, code)`` and the values that
    ``more`` (a day's rows) brings.  Old values keep their codes; new ones are
    numbered behind their field's largest, in order of appearance, so adding
    day by day gives the codes of all days at once."""
    names = F.array(*[F.lit(c) for c in cols])
    values = value_table(more, cols, order)
    values = values.select(F.element_at(names, F.col("g") + 1).alias("field"), "g", "v", "first")
    if codes is None:
        return staged(numbered_values(values).select("field", "v", "code"), "code-table")
    old = codes.select(F.col("field").alias("__f"), F.col("v").alias("__v"))
    new = values.join(old, (F.col("field") == F.col("__f")) & F.col("v").eqNullSafe(F.col("__v")), "left_anti")
    last = codes.groupBy(F.col("field").alias("__f")).agg(F.max("code").alias("__last"))  # one row a field
    new = numbered_values(staged(new, "new-values")).join(F.broadcast(last), F.col("field") == F.col("__f"), "left")
    new = new.select("field", "v", (F.col("code") + F.coalesce("__last", F.lit(0))).alias("code"))
    return staged(codes.unionByName(new), "code-table")


def coded(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    """``{col}{suffix}`` out of a code table (NULL: a value that it does not hold);
    each field's part is broadcast up to its measured bytes."""
    width = F.coalesce(F.octet_length("v"), F.lit(0)) + F.lit(24)
    size = {r["field"]: r["b"] for r in codes.groupBy("field").agg(F.sum(width).alias("b")).collect()}
    out = df
    for i, c in enumerate(cols):
        t = codes.where(F.col("field") == c).select(F.col("v").alias(f"__v{i}"), F.col("code").alias(f"{c}{suffix}"))
        t = F.broadcast(t) if size.get(c, 0) <= BROADCAST_BYTES else t
        out = out.join(t, F.col(c).cast("string").eqNullSafe(F.col(f"__v{i}")), "left").drop(f"__v{i}")
    return out


def _minmax(df: DataFrame, cols: list[str]):
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}")]
    return df.agg(*aggs).first()


def equal_width_bins(df: DataFrame, cols: list[str], bins: int = 10, suffix: str = "_bin",
                     stats: DataFrame | None = None) -> DataFrame:
    """Pandas ``cut(x, bins)`` codes - equal-width, right-closed bins.

    ``ceil((x-min)/width) - 1`` clamped at 0 (the lowest edge is open just
    below min).  A constant column lands in the middle bin ``bins//2 - 1``;
    NULL stays NULL (``greatest`` would skip it and give 0).  Min/max are two
    scalars per column (one tiny aggregate).
    """
    m = _minmax(df if stats is None else stats, cols)
    out = []
    for c in cols:
        mn, mx = m[f"mn_{c}"], m[f"mx_{c}"]
        x = F.col(c)
        if mn is None:
            b = F.lit(None).cast("int")
        elif mn == mx:
            b = F.when(x.isNotNull(), F.lit(bins // 2 - 1))
        else:
            width = (F.lit(float(mx)) - F.lit(float(mn))) / F.lit(float(bins))
            raw = F.ceil((x - F.lit(float(mn))) / width) - 1
            b = F.when(x.isNotNull(), F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)))
        out.append(b.cast("int").alias(f"{c}{suffix}"))
    return df.select("*", *out)


def standardize(df: DataFrame, cols: list[str], suffix: str = "_std", stats: DataFrame | None = None) -> DataFrame:
    """E5: ``(x - mean) / population sd`` (``StandardScaler`` uses sample sd)."""
    src = df if stats is None else stats
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}")]
    m = src.agg(*aggs).first()
    out = []
    for c in cols:
        mu, sd = m[f"mu_{c}"], m[f"sd_{c}"]
        if mu is None or not sd:
            out.append(F.lit(None).cast("double").alias(f"{c}{suffix}"))
        else:
            out.append(((F.col(c) - F.lit(mu)) / F.lit(sd)).alias(f"{c}{suffix}"))
    return df.select("*", *out)
