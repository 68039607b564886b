"""Field-aware sparse text rows (K4, E7) and hashed tokens.

A row is ``label field:index:1 field:index:1 … `` - the label, then one
token per scalar feature and one per element of each list feature, each
followed by a space (the reference's exact layout).  Field numbers are the
positions of the features in ``list_features + scalar_features +
extra_features`` (E7).  Built with ``transform``/``concat_ws`` inside one
projection; the rows go to ``DataFrame.write.text`` (one part file per
partition), never through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickfeat.functions.lists import hashed_token
from clickfeat.operators.encode import BROADCAST_BYTES, consecutive_index, staged

# The dictionary's numbers of a field of codes below this are constants of the plan.
LITERAL_VALUES = 4096


def field_numbers(list_features, scalar_features, extra_features=()) -> dict[str, int]:
    """Feature name -> field number (its position)."""
    return {f: i for i, f in enumerate([*list_features, *scalar_features, *extra_features])}


def _list_tokens(n: int, column: str, numeric: bool) -> Column:
    """The tokens of a list's elements in one text; missing elements and lists have none.  Elements
    that are numbers are joined as they are, without a function called for each."""
    own = F.col(column).cast("array<string>")
    if not numeric:
        return F.array_join(F.transform(own, lambda x: F.concat(F.lit(f"{n}:"), x, F.lit(":1 "))), "")
    text = F.array_join(own, f":1 {n}:")
    return F.when(text != "", F.concat(F.lit(f"{n}:"), text, F.lit(":1 ")))


def ffm_line(label: str, list_features, scalar_features, extra_features=(), kinds: dict | None = None) -> Column:
    """``kinds``: the types of the columns, where they are known."""
    fields, numbers = field_numbers(list_features, scalar_features, extra_features), ("array<int>", "array<bigint>")
    parts = [_list_tokens(fields[f], f, (kinds or {}).get(f) in numbers) for f in list_features]
    parts += [F.concat(F.lit(f"{fields[f]}:"), F.col(f).cast("string"), F.lit(":1 ")) for f in [*scalar_features, *extra_features]]
    return F.concat(F.col(label).cast("string"), F.lit(" "), F.concat_ws("", *parts) if parts else F.lit(""))


def ffm_rows(df: DataFrame, label: str, list_features, scalar_features, extra_features=(),
             key: str | None = "instance_id") -> DataFrame:
    line = ffm_line(label, list_features, scalar_features, extra_features, dict(df.dtypes)).alias("line")
    return df.select(key, line) if key else df.select(line)


def feature_dictionary(table: DataFrame, first: int, k: int = 100, threshold: int = 10) -> tuple[DataFrame, int]:
    """E7 for fields that depend on data: ``(Field, Value, num)`` and the number of
    fields.  Every frequent ``Field-Value`` of the frequency table is a field,
    numbered by name from ``first`` on (a distributed numbering: there may be
    many); behind them the ``k`` of highest ratio are fields once more, in the
    order of the ratio."""
    table = staged(table.where(F.col("Total") >= threshold).withColumn("feature", F.concat_ws("-", "Field", "Value")), "frequent")
    n = table.count()
    frequent = consecutive_index(table.select("Field", "Value", "feature"), ["feature"], "__i")
    top = table.orderBy(F.col("Ratio").desc(), "feature").limit(k)
    top = top.withColumn("__i", F.row_number().over(Window.orderBy(F.col("Ratio").desc(), "feature")))  # k rows
    numbers = (frequent.select("Field", "Value", (F.col("__i") + (first - 1)).cast("bigint").alias("num"))
               .unionByName(top.select("Field", "Value", (F.col("__i") + (first + n - 1)).cast("bigint").alias("num"))))
    return staged(numbers, "feature-dictionary"), n + min(n, k)


def dictionary_fields(df: DataFrame, dictionary: DataFrame, list_features, scalar_features, key: str = "instance_id") -> DataFrame:
    """``key, fields``: the numbers of the dictionary's fields that a row has, in
    order.  The row's (field, value) pairs are joined with the dictionary, which
    is broadcast where its measured bytes allow it; beyond that hot values are
    split by the skew join."""
    pair = lambda f: lambda v: F.struct(F.lit(f).alias("Field"), v.cast("string").alias("Value"))
    none = F.array().cast("array<struct<Field:string,Value:string>>")
    pairs = F.concat(F.array(*[pair(f)(F.col(f)) for f in scalar_features]) if scalar_features else none,
                     *[F.coalesce(F.transform(F.col(f), pair(f)), none) for f in list_features])
    long = df.select(key, F.explode(pairs).alias("p")).select(key, "p.Field", "p.Value")
    size = dictionary.agg(F.sum(F.octet_length("Field") + F.coalesce(F.octet_length("Value"), F.lit(0)) + 24)).first()[0] or 0
    found = long.join(F.broadcast(dictionary) if size <= BROADCAST_BYTES else dictionary, ["Field", "Value"])
    return found.groupBy(key).agg(F.array_sort(F.collect_list("num")).alias("fields"))


def with_dictionary_fields(df: DataFrame, dictionary: DataFrame, list_features, scalar_features, key: str = "instance_id") -> DataFrame:
    """``df`` and ``fields``, the numbers of ``dictionary_fields``, without listing a row's pairs.

    Each field is looked up on its own.  The numbers of a field of codes of up to
    ``LITERAL_VALUES`` are constant arrays that a code is a place of.  A scalar with
    more is joined with its part of the dictionary, broadcast where the measured bytes
    allow it; only for lists of other values, if there are any, pairs are joined."""
    kinds, names = dict(df.dtypes), [*list_features, *scalar_features]
    each = staged(dictionary.where(F.col("Field").isin(names) & F.col("Value").isNotNull()).groupBy("Field", "Value")
                  .agg(F.sort_array(F.collect_list("num")).alias("nums")), "dictionary-numbers")
    width = F.octet_length("Value") + F.lit(24) + 8 * F.size("nums")
    sizes = {r["Field"]: r for r in each.groupBy("Field").agg(
        F.sum(width).alias("b"), F.max(F.coalesce(F.col("Value").try_cast("bigint"), F.lit(1 << 40))).alias("most"),
        F.min(F.coalesce(F.col("Value").try_cast("bigint"), F.lit(-1))).alias("least"), F.max(F.size("nums")).alias("k")).collect()}
    codes = ("int", "bigint", "array<int>", "array<bigint>")
    near = [f for f in names if f in sizes and kinds[f] in codes and sizes[f]["least"] >= 0 and sizes[f]["most"] < LITERAL_VALUES]
    numbers = {f: np.zeros((sizes[f]["k"], sizes[f]["most"] + 1), np.int64) for f in near}
    for r in each.where(F.col("Field").isin(near)).collect() if near else []:  # at most LITERAL_VALUES rows a field
        if str(int(r["Value"])) == r["Value"]:
            numbers[r["Field"]][:len(r["nums"]), int(r["Value"])] = r["nums"]
    none, parts, out = F.array().cast("array<bigint>"), [], df
    for f in near:
        tables = [F.lit(row) for row in numbers[f]]
        found = lambda c, ts=tables: F.array(*[F.coalesce(F.get(t, c.cast("int")), F.lit(0).cast("bigint")) for t in ts])
        if f in scalar_features:
            parts.append(found(F.col(f)))
        else:
            parts.append(F.coalesce(F.flatten(F.transform(F.col(f), lambda c: found(c))), none))
    for i, f in enumerate(scalar_features):
        if f in sizes and f not in near:
            t = each.where(F.col("Field") == f).select(F.col("Value").alias(f"__value{i}"), F.col("nums").alias(f"__nums{i}"))
            t = F.broadcast(t) if sizes[f]["b"] <= BROADCAST_BYTES else t
            out = out.join(t, F.col(f).cast("string") == F.col(f"__value{i}"), "left")
            parts.append(F.coalesce(F.col(f"__nums{i}"), none))
    other = [f for f in list_features if f in sizes and f not in near]
    if other:
        of = dictionary_fields(df, dictionary, other, [], key).select(F.col(key).alias("__key"), F.col("fields").alias("__others"))
        out = out.join(of, F.col(key) == F.col("__key"), "left")
        parts.append(F.coalesce("__others", none))
    fields = F.array_remove(F.sort_array(F.concat(*parts)), F.lit(0).cast("bigint")) if parts else none
    return out.select(*[df[c] for c in df.columns], fields.alias("fields"))


def ffm_rows_online(df: DataFrame, label: str, list_features, scalar_features, first_extra: int = 0,
                    extra_features=(), key: str = "instance_id") -> DataFrame:
    """Rows (with ``fields``, see ``with_dictionary_fields``) with the dictionary's fields behind the fixed ones
    (``num:1:1``) and ``extra_features`` (tree leaves), numbered from ``first_extra``, at the end."""
    numbers = F.array_join(F.col("fields").cast("array<string>"), ":1:1 ")
    line = F.concat(ffm_line(label, list_features, scalar_features, kinds=dict(df.dtypes)),
                    F.concat_ws("", F.when(F.size("fields") > 0, F.concat(numbers, F.lit(":1:1 "))),
                                *[F.concat(F.lit(f"{first_extra + i}:"), F.col(f).cast("string"), F.lit(":1 ")) for i, f in enumerate(extra_features)]))
    return df.select(*[c for c in (key, "day") if c in df.columns], line.alias("line"))


def hashed_tokens(fields: dict[str, str], nr_bins: int = 10 ** 6) -> Column:
    """A10: ``field:md5bucket(value):1`` for ``{field_name: column}``, space-joined."""
    return F.concat_ws(" ", *[hashed_token(F.lit(f), F.col(c), nr_bins) for f, c in fields.items()])


def _above(lines: pa.Array, first: int) -> np.ndarray:
    """Of each line the tokens behind its label whose field number, the digits before the first colon,
    is above ``first``, read off the text's bytes."""
    if not len(lines):
        return np.zeros(0, np.int64)
    lines = pc.fill_null(lines, "").cast(pa.large_binary())
    at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
    text = np.frombuffer(lines.buffers()[2], np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    # a line's tokens begin behind its blanks, the label at its start
    begin = np.flatnonzero(text == 32) + 1
    line = np.searchsorted(at, begin - 1, side="right") - 1
    inside = begin < at[line + 1]
    begin, line = begin[inside], line[inside]
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    number, going, digits, bad = np.zeros(len(begin), np.int64), np.ones(len(begin), bool), np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)
    for step in range(11):
        own = padded[np.minimum(begin + step, len(text))]
        over = begin + step >= at[line + 1]
        digit = going & ~over & (own >= 48) & (own <= 57)
        bad |= going & ~digit & ~over & (own != 58) & (own != 32)  # another sign in the field
        number[digit] = number[digit] * 10 + own[digit] - 48
        digits += digit
        going = digit
        if not going.any():
            break
    found = ~bad & ~going & (digits > 0) & (number > first) & (number < 1 << 31)
    return np.bincount(line[found], minlength=len(lines))


def fields_above(df: DataFrame, column: str, first: int, name: str) -> DataFrame:
    """``df`` and ``name``: the tokens of the text row in ``column`` whose field is above ``first``."""
    def run(batches):
        for b in batches:
            yield b.append_column(name, pa.array(_above(b.column(column), first), pa.int64()))
    return df.mapInArrow(run, df.withColumn(name, F.lit(0).cast("bigint")).schema)


def write_ffm(rows: DataFrame, path: str) -> None:
    rows.select("line").write.mode("overwrite").text(path)
