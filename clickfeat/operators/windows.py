"""Order-dependent per-group features.

Every window orders by ``(ts, key)`` so ties in time are broken by the row
key (the reference used file order and an unstable sort).  Frames:

* W1 ``diff_1``/``diff_2``: minutes to the previous/next click (``lag``/``lead``).
* W2 ``diff_3``/``diff_4``: minutes to the group's last/first click.
* W3 history: labels of strictly earlier clicks, concatenated; labels on or
  after ``mask_day`` are written as ``0`` (P14) so the holdout day never
  leaks its own labels.
* W4 ordinals (running count of the group's clicks) and W5 first/last-of-day
  flags; "last" is per group (the reference compared with a global maximum).

All scopes of a call run over one exchange by user, and a user with very many
rows is cut into chunks (``clickfeat.operators.ordered``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickfeat.operators.ordered import CHUNK_ROWS, add_scopes, dealt, recent_counts, split_anchors

# Scope -> (partition keys, column prefix, history column).
SCOPES = {
    "day": (["user_id", "day"], "", "history"),
    "all": (["user_id"], "all_", "all_history"),
    "item": (["user_id", "item_id"], "item_", "item_history"),
    "cat1": (["user_id", "category_1"], "cat1_", "cat1_history"),
}

# Ordinal name -> partition keys (W4); ``*_day`` ones also get W5 flags.
ORDINALS = {
    "sum": ["user_id"],
    "sum_day": ["user_id", "day"],
    "sum_item": ["item_id", "user_id"],
    "sum_item_day": ["item_id", "user_id", "day"],
    "sum_cat1": ["category_1", "user_id"],
    "sum_cat1_day": ["category_1", "user_id", "day"],
    "sum_shop": ["shop_id", "user_id"],
    "sum_shop_day": ["shop_id", "user_id", "day"],
}


def label_mask(label: str = "is_trade", day: str = "day", mask_day: int = 24) -> Column:
    """The label as a one-character string, ``'0'`` on/after ``mask_day``."""
    return F.when(F.col(day) < mask_day, F.col(label).cast("string")).otherwise(F.lit("0"))


def add_history(df: DataFrame, scopes, mask_day: int = 24, ts: str = "context_timestamp", key: str = "instance_id",
                label: str = "is_trade", scope_defs: dict | None = None, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """W3 for the named scopes.  The rows of a cut user are strung together
    chunk by chunk, behind the labels of the chunks before; the text itself
    grows with the rows before it, as asked for."""
    defs = scope_defs or SCOPES
    plain, chunked = (df, None) if chunk_rows is None else split_anchors(df, "user_id", ts, key, chunk_rows)
    lab = label_mask(label, "day", mask_day)

    def local(d, extra):
        def prior(keys):
            w = Window.partitionBy(*keys, *extra).orderBy(ts, key).rowsBetween(Window.unboundedPreceding, -1)
            return F.array_join(F.collect_list(lab).over(w), "")
        return d.select("*", *[prior(defs[s][0]).alias(defs[s][2]) for s in scopes])

    out = local(dealt(plain, "user_id"), [])
    if chunked is None:
        return out
    hot = local(dealt(chunked, "user_id", "__chunk"), ["__chunk"])
    for i, scope in enumerate(scopes):
        keys, _, name = defs[scope]
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts), F.col(key), lab.alias("l")))), lambda x: x["l"]), "")
        each = chunked.groupBy(*keys, "__chunk").agg(texts.alias("__text"))
        w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        each = each.select(*[F.col(c).alias(f"__{i}{c}") for c in (*keys, "__chunk")],
                           F.array_join(F.collect_list("__text").over(w), "").alias(f"__{i}before"))
        on = [hot[k].eqNullSafe(each[f"__{i}{k}"]) for k in (*keys, "__chunk")]
        hot = hot.join(each, on, "left").select(*[F.concat(F.coalesce(f"__{i}before", F.lit("")), name).alias(name) if c == name else hot[c]
                                                  for c in hot.columns])
    return out.unionByName(hot.select(*out.columns))


# Moduli and bases of the two polynomials of a history's identifier (fixed values).
_FIELDS = ((2147483647, 911382323), (2147483629, 972663749))
_DIGIT_BITS, _DIGITS = 6, 6  # exponents below 2^36


def _power_tables() -> list[list[Column]]:
    """For each field and digit the powers of the digit's values, one constant each."""
    return [[F.lit(np.array([pow(base, k << (_DIGIT_BITS * d), modulus) for k in range(1 << _DIGIT_BITS)])) for d in range(_DIGITS)]
            for modulus, base in _FIELDS]


def _power(n: Column, tables: list[Column], modulus: int) -> Column:
    """``base ** n mod modulus``: the product over the digits of ``n``."""
    out = None
    for d, table in enumerate(tables):
        digit = F.shiftright(n, _DIGIT_BITS * d).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1))
        factor = F.element_at(table, (digit + 1).cast("int"))
        out = factor if out is None else out * factor % modulus
    return out


def add_history_ids(df: DataFrame, scopes, mask_day: int = 24, ts: str = "context_timestamp", key: str = "instance_id",
                    label: str = "is_trade", scope_defs: dict | None = None, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """``{history}_id`` for the named scopes: an identifier of constant size that is
    equal where the histories of ``add_history`` are equal, for encoding them
    without their texts.

    It is the history's length and two polynomials of its labels modulo primes
    near 2^31, all running sums, so a row costs the same wherever it stands.
    Lengths and polynomials compose: those of a chunk, shifted by the labels
    before it, are added up over the chunks of a cut user, and joined to its
    rows (different histories of one length collide with a chance of 2^-62)."""
    defs = scope_defs or SCOPES
    need = sorted({k for s in scopes for k in defs[s][0]} | {"day"})
    plain, chunked = (df, None) if chunk_rows is None else split_anchors(df, "user_id", ts, key, chunk_rows)
    lab, fields = label_mask(label, "day", mask_day), [(tables, f[0]) for tables, f in zip(_power_tables(), _FIELDS)]

    def local(d, extra):
        """``__n{i}``, ``__h{i}_{f}``: labels before the row, in its chunk, and their
        polynomials; ``__t{i}_{f}``: the row's own term."""
        group = [Window.partitionBy(*defs[s][0], *extra).orderBy(ts, key).rowsBetween(Window.unboundedPreceding, -1) for s in scopes]
        value = F.ascii(lab) + 1
        d = d.select("*", *[F.count(lab).over(w).alias(f"__n{i}") for i, w in enumerate(group)])
        terms = [(F.coalesce(value, F.lit(0)) * _power(F.col(f"__n{i}"), *f) % f[1]).alias(f"__t{i}_{k}")
                 for i in range(len(group)) for k, f in enumerate(fields)]
        d = d.select("*", *terms)
        return d.select("*", *[(F.coalesce(F.sum(f"__t{i}_{k}").over(w), F.lit(0)) % f[1]).alias(f"__h{i}_{k}")
                               for i, w in enumerate(group) for k, f in enumerate(fields)])

    def named(d):
        return d.select(*df.columns, *[F.concat_ws(":", f"__n{i}", *[f"__h{i}_{k}" for k in range(len(_FIELDS))]).alias(f"{defs[s][2]}_id")
                                       for i, s in enumerate(scopes)])

    out = named(local(dealt(plain, "user_id"), []))
    if chunked is None:
        return out
    hot = local(dealt(chunked, "user_id", "__chunk"), ["__chunk"])
    kept = hot.columns
    for i, scope in enumerate(scopes):
        keys = defs[scope][0]
        along = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        each = (local(dealt(chunked.select(key, ts, label, "__chunk", *need), "user_id", "__chunk"), ["__chunk"])
                .groupBy(*keys, "__chunk").agg(F.count(lab).alias("n"), *[(F.sum(f"__t{i}_{k}") % f[1]).alias(f"h{k}") for k, f in enumerate(fields)]))
        each = each.select("*", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
        each = each.select("*", *[(F.col(f"h{k}") * _power(F.col("before"), *f) % f[1]).alias(f"s{k}") for k, f in enumerate(fields)])
        each = each.select(*[F.col(c).alias(f"__c_{c}") for c in (*keys, "__chunk")], F.col("before").alias("__before"),
                           *[(F.coalesce(F.sum(f"s{k}").over(along), F.lit(0)) % f[1]).alias(f"__s{k}") for k, f in enumerate(fields)])
        on = [F.col(c).eqNullSafe(F.col(f"__c_{c}")) for c in (*keys, "__chunk")]
        moved = {f"__n{i}": F.col("__before") + F.col(f"__n{i}")}
        for k, f in enumerate(fields):
            moved[f"__h{i}_{k}"] = (F.col(f"__s{k}") + F.col(f"__h{i}_{k}") * _power(F.col("__before"), *f)) % f[1]
        hot = hot.join(each, on, "left").select(*[moved[c].alias(c) if c in moved else F.col(c) for c in kept])
    return out.unionByName(named(hot))


def add_gaps(df: DataFrame, scopes=("day", "all", "item", "cat1"), mask_day: int = 24,
             ts: str = "context_timestamp", key: str = "instance_id", label: str = "is_trade",
             with_history: bool = True, scope_defs: dict | None = None,
             max_group_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """W1-W3 for the named scopes (default: all four of the reference).  A user
    with more than ``max_group_rows`` rows is cut into chunks (see
    ``clickfeat.operators.ordered``)."""
    defs = scope_defs or SCOPES
    specs = {f"__{s}": (defs[s][0], ("prev", "next", "last", "first")) for s in scopes}
    out = add_scopes(df, specs, ts, key, chunk_rows=max_group_rows)
    names = []
    if with_history:
        names = [defs[s][2] for s in scopes]
        out = add_history(out, scopes, mask_day, ts, key, label, defs, max_group_rows)
    cols = []
    for s in scopes:
        cols += gap_columns(f"__{s}", defs[s][1], ts) + ([F.col(defs[s][2])] if names else [])
    return out.select(*df.columns, *cols)


def gap_columns(name: str, prefix: str, ts: str = "context_timestamp") -> list[Column]:
    """``{prefix}diff_1..4`` out of the scope columns of ``name``."""
    t, c = F.col(ts), lambda x: F.col(f"{name}__{x}")
    return [(F.abs(t - c("prev")) / 60.0).alias(f"{prefix}diff_1"), (F.abs(t - c("next")) / 60.0).alias(f"{prefix}diff_2"),
            ((c("last") - t) / 60.0).alias(f"{prefix}diff_3"), ((t - c("first")) / 60.0).alias(f"{prefix}diff_4")]


def ordinal_columns(name: str, spec: str) -> list[Column]:
    """The ordinal ``name`` and, for ``*_day`` ones, the first/last flags."""
    rn, out = F.col(f"{spec}__rn"), [F.col(f"{spec}__rn").alias(name)]
    if name.endswith("_day"):
        out += [(rn == 1).cast("int").alias(f"{name[:-4]}_first_day"),
                (rn == F.col(f"{spec}__n")).cast("int").alias(f"{name[:-4]}_last_day")]
    return out


def ordinal_specs(ordinals: dict) -> dict:
    return {f"__{n}": (keys, ("rn", "n") if n.endswith("_day") else ("rn",)) for n, keys in ordinals.items()}


def add_ordinals(df: DataFrame, ordinals: dict | None = None, ts: str = "context_timestamp",
                 key: str = "instance_id", max_group_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """W4 ordinals and W5 first/last flags (for every ``*_day`` ordinal)."""
    ords = ordinals or ORDINALS
    out = add_scopes(df, ordinal_specs(ords), ts, key, chunk_rows=max_group_rows)
    return out.select(*df.columns, *[c for n in ords for c in ordinal_columns(n, f"__{n}")])


def add_recent_clicks(df: DataFrame, seconds: int = 3600, ts: str = "context_timestamp",
                      key: str = "instance_id", max_group_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Notes' idea: clicks repeated within a short time (RANGE frame on the
    epoch seconds, ties included) and the duration of the day's clicks.  The
    rows of a cut user get the counts by merged ranks."""
    t, cols = F.col(ts), list(df.columns)
    plain, chunked = (df, None) if max_group_rows is None else split_anchors(df, "user_id", ts, key, max_group_rows)
    rng = lambda *k: Window.partitionBy(*k).orderBy(t).rangeBetween(-seconds, 0)
    day = Window.partitionBy("user_id", "day")
    out = dealt(plain, "user_id").select(
        "*", F.count(F.lit(1)).over(rng("user_id")).cast("bigint").alias("clicks_last_hour"),
        F.count(F.lit(1)).over(rng("user_id", "item_id")).cast("bigint").alias("item_clicks_last_hour"),
        ((F.max(t).over(day) - F.min(t).over(day)) / 60.0).alias("day_span_minutes"))
    if chunked is None:
        return out
    hot = chunked.drop("__chunk")
    for name, keys in (("clicks_last_hour", ["user_id"]), ("item_clicks_last_hour", ["user_id", "item_id"])):
        hot = hot.join(recent_counts(chunked, keys, seconds, ts, key, name, max_group_rows=max_group_rows), key, "left")
    span = chunked.groupBy(F.col("user_id").alias("__u"), F.col("day").alias("__d")).agg(((F.max(t) - F.min(t)) / 60.0).alias("day_span_minutes"))
    hot = hot.join(span, hot["user_id"].eqNullSafe(span["__u"]) & hot["day"].eqNullSafe(span["__d"]), "left")
    return out.unionByName(hot.select(*cols, "clicks_last_hour", "item_clicks_last_hour", "day_span_minutes"))
