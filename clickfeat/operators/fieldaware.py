"""Distributed training of a field-aware factorisation machine (M3).

A row is a list of (field, index) features.  Every feature has one latent
vector for every other field, and a row's margin is the sum over its pairs of
features ``a, b`` of ``<v[a, field of b], v[b, field of a]>``, divided by the
number of its features.  The mean logistic loss plus ``reg / 2`` times the squared
vectors is minimised by AdaGrad on the full gradient.

Parameters are a table of one row for each feature, with its vectors for all
fields; nothing of it is ever on the driver.  Rows are dealt into blocks of
bounded size, in the order of the field with the most values, so that a value
is in few blocks, and each block is packed once.  A block gets the parameters
of the features it holds (one join a round, on the distinct features of the
blocks), computes its part of the gradient with numpy, sums it by feature, and
an aggregate adds the parts up.  A feature in a third of all rows is a row a
block.  Each round's table is written to the shared folder, so a lost executor
costs its tasks only.

A block's pairs are worked field by field.  Of two fields with few combinations in the block
all products ``<v[a, g], v[b, f]>`` are one small matrix product: a row's margin reads its own, and the
gradient is the matrix of the rows' weights, added up by combination, times the vectors.  So a row
costs one look-up and one addition a pair, not its vectors; where there are more combinations
than that saves, the rows' vectors are multiplied.  A field of which rows have several
features takes part feature by feature; two such fields meet by their sums, where a feature's pair
with itself is taken off.

NULL labels count as 0; NULL feature lists are empty and score 0.5; a feature
that training never saw adds nothing; repeated features count as often as they
stand there; rows may share a key when training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clickfeat.operators.encode import staged

BLOCK_ROWS = 20_000
TABLE_ROWS = 8  # combinations of two fields' features for each row, up to which they are worked as a table
FEATURE = "array<struct<field:int,index:string>>"


def features(list_features, scalar_features) -> Column:
    """The ``features`` of coded rows: fields numbered as in the text rows."""
    pair = lambda n: lambda v: F.struct(F.lit(n).alias("field"), v.cast("string").alias("index"))
    names = [*list_features, *scalar_features]
    none = F.array().cast(FEATURE)
    parts = [F.coalesce(F.transform(f, pair(i)), none) if i < len(list_features) else F.array(pair(i)(F.col(f))) for i, f in enumerate(names)]
    return F.concat(*parts).cast(FEATURE)


def _seen(rows: DataFrame) -> DataFrame:
    """The distinct features."""
    return rows.select(F.explode("features").alias("f")).select("f.field", "f.index").distinct()


def _most(seen: DataFrame) -> int | None:
    """The field with the most values (a row a field)."""
    top = seen.groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "field").first()
    return None if top is None else top["field"]


def _dealt(rows: DataFrame, label: str | None, key: str, near: int | None, keep: list[str]) -> DataFrame:
    """Rows with their ``block``, a partition each: those of one value of field ``near`` together."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    cols = [F.col(key).alias("key"), F.coalesce("features", F.array().cast(FEATURE)).alias("features")]
    cols.append(F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y") if label else F.lit(0).alias("y"))
    cols += [F.col(c).alias(f"keep_{c}") for c in keep]
    if near is None:
        return rows.select(*cols).repartition(n).withColumn("block", F.spark_partition_id())
    # by position, not by key: equal keys are spread too, and a value of too many rows is cut
    rows = rows.select(*cols, F.xxhash64(F.monotonically_increasing_id()).alias("__at"))
    rows = rows.withColumn("__near", F.get(F.filter("features", lambda f: f["field"] == near), F.lit(0))["index"])
    return rows.repartitionByRange(n, "__near", "__at").withColumn("block", F.spark_partition_id()).drop("__near", "__at")


def _blocks(rows: DataFrame, label: str | None, key: str, near: int | None = None) -> DataFrame:
    """Rows with their ``block``, written."""
    return staged(_dealt(rows, label, key, near, []), "ffm-blocks")


def _pack(rows: pa.Table) -> pa.Table:
    """The rows of a block as one."""
    items = rows.column("features").combine_chunks()
    flat = items.flatten()
    name = pc.binary_join_element_wise(pc.cast(pc.struct_field(flat, "field"), pa.string()), pc.struct_field(flat, "index"), ":").dictionary_encode()
    names = name.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.full(len(names) + 1, -1, np.int32)  # the last is of NULLs
    place[order] = np.arange(len(names), dtype=np.int32)
    code = place[name.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
    parts = [names[i].partition(":") for i in order]
    own = pa.StructArray.from_arrays([pa.array([int(p[0]) for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.string())], ["field", "index"])
    whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    size = pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int32)
    kept = {c: whole(rows.column(c).combine_chunks()) for c in ("key", "y", *rows.column_names) if c in ("key", "y") or c.startswith("keep_")}
    return pa.table({"block": rows.column("block").slice(0, 1).combine_chunks(), "size": whole(pa.array(size)), "code": whole(pa.array(code, pa.int32())), "names": whole(own), **kept})


def _packed(blocks: DataFrame, together: bool = False) -> DataFrame:
    """One row a block: keys, labels and numbers of features of its rows, all features
    by code, and the features that the codes (places in their order) stand for;
    -1 is a feature without index.  ``together``: a block is a partition as it is."""
    kinds = dict(blocks.dtypes)
    arrays = [f"{c} array<{t}>" for c, t in kinds.items() if c in ("key", "y") or c.startswith("keep_")]
    schema = f"block int, size array<int>, code array<int>, names {FEATURE}, " + ", ".join(arrays)
    if not together:
        return blocks.groupBy("block").applyInArrow(_pack, schema)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _pack(pa.Table.from_batches(held)).to_batches()
    return blocks.mapInArrow(run, schema)


def _needed(blocks: DataFrame) -> DataFrame:
    """The distinct features of every block, with their codes."""
    packed = blocks if "names" in blocks.columns else _packed(blocks)
    one = packed.select("block", F.posexplode("names").alias("code", "f"))
    return staged(one.select("block", "code", "f.field", "f.index"), "ffm-needed")


class _Block:
    """A block's rows and its parameters as arrays, by field: ``of[f]`` is the place of each row's feature
    among the block's features of the field (their number where a row has none), or, where rows
    have several, the rows and places of all its features; ``w[f]`` is the vectors by place,
    zeros for the last."""

    def __init__(self, packed: pa.Table, own: pa.Table, factors: int, n_fields: int):
        flat = lambda c: packed.column(c).combine_chunks().flatten()
        self.size = flat("size").to_numpy(zero_copy_only=False).astype(np.int64)
        code, self.names = flat("code").to_numpy(zero_copy_only=False), flat("names")
        known, n = len(self.names), len(self.size)
        w = np.zeros((known, n_fields, factors))
        self.there = own.column("code").to_numpy()
        if own.num_rows:
            w[self.there] = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, n_fields, factors)
        # features without index (-1) add nothing
        row = np.repeat(np.arange(n), self.size)[code >= 0]
        code = code[code >= 0]
        field = pc.struct_field(self.names, "field").to_numpy(zero_copy_only=False).astype(np.int16)
        by = np.argsort(field[code], kind="stable")
        row, code, cut = row[by], code[by], np.searchsorted(field[code[by]], np.arange(n_fields + 1))
        self.own, self.w, self.of = {}, {}, {}
        place = np.zeros(known, np.int64)
        for f in np.unique(field).tolist():
            self.own[f] = np.flatnonzero(field == f)
            place[self.own[f]] = np.arange(len(self.own[f]))
            self.w[f] = np.concatenate([w[self.own[f]], np.zeros((1, n_fields, factors))])
            r, u = row[cut[f]:cut[f + 1]], place[code[cut[f]:cut[f + 1]]]
            self.of[f] = r, u
            if (np.diff(r) > 0).all():
                self.of[f] = np.full(n, len(self.own[f]))
                self.of[f][r] = u
        self.single = [f for f in self.of if not isinstance(self.of[f], tuple)]
        self.several = [f for f in self.of if isinstance(self.of[f], tuple)]

    def _met(self):
        """Of every pair of fields whose second has one feature a row: the pair, the rows of the first's
        features (None: one a row), their places and those of the second's in the same rows, the vectors
        of either for the other, and whether a table of all combinations costs less than the rows."""
        for i, g in enumerate(self.single):
            for f in [*self.single[:i], *self.several]:
                r, u = self.of[f] if f in self.several else (None, self.of[f])
                v, a, b = self.of[g] if r is None else self.of[g][r], np.ascontiguousarray(self.w[f][:, g]), np.ascontiguousarray(self.w[g][:, f])
                yield f, g, r, u, v, a, b, len(a) * len(b) <= TABLE_ROWS * len(u)

    def _summed(self, f, g):
        """By row the sum of the vectors for ``g`` of its features of field ``f``."""
        r, u = self.of[f]
        return _scattered(r, self.w[f][u, g], len(self.size))

    def margins(self) -> np.ndarray:
        """The rows' sums over their pairs, divided by their numbers of features."""
        n = len(self.size)
        total = np.zeros(n)
        for _, _, r, u, v, a, b, table in self._met():
            x = (a @ b.T).ravel().take(u * len(b) + v) if table else np.einsum("ij,ij->i", a[u], b[v])
            total += x if r is None else np.bincount(r, x, n)
        for i, f in enumerate(self.several):
            r, u = self.of[f]
            total += ((self._summed(f, f) ** 2).sum(axis=1) - np.bincount(r, (self.w[f][u, f] ** 2).sum(axis=1), n)) / 2
            for g in self.several[:i]:
                total += (self._summed(f, g) * self._summed(g, f)).sum(axis=1)
        return total / np.maximum(self.size, 1)

    def gradient(self, y: np.ndarray):
        """Summed gradient of the losses, by feature, and the summed loss."""
        sign = np.where(y > 0, 1.0, -1.0)
        margin = sign * self.margins()
        kappa = -sign / (1 + np.exp(margin)) / np.maximum(self.size, 1)
        g_of = {f: np.zeros_like(w) for f, w in self.w.items()}
        for f, g, r, u, v, a, b, table in self._met():
            weight = kappa if r is None else kappa[r]
            if table:  # the weights of every combination
                met = np.bincount(u * len(b) + v, weight, len(a) * len(b)).reshape(len(a), len(b))
                g_of[f][:, g] += met @ b
                g_of[g][:, f] += met.T @ a
            else:
                g_of[f][:, g] += _scattered(u, weight[:, None] * b[v], len(a))
                g_of[g][:, f] += _scattered(v, weight[:, None] * a[u], len(b))
        for f in self.several:
            r, u = self.of[f]
            for g in self.several:
                slope = self._summed(g, f)[r]
                if f == g:  # a feature makes no pair with itself
                    slope -= self.w[f][u, f]
                g_of[f][:, g] += _scattered(u, kappa[r][:, None] * slope, len(self.w[f]))
        out = np.zeros((len(self.names), *next(iter(self.w.values())).shape[1:])) if self.w else np.zeros((0, 1, 1))
        for f, own in self.own.items():
            out[own] = g_of[f][:-1]
        return out, float(np.logaddexp(0, -margin).sum())


def _scattered(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of ``values`` by their places ``at``."""
    return np.stack([np.bincount(at, values[:, i], n) for i in range(values.shape[1])], axis=1)


_KEY = ["field", "index", "other"]


def _columns(letter: str, factors: int) -> list[str]:
    return [f"{letter}{i}" for i in range(factors)]


def start(rows: DataFrame, n_fields: int, factors: int, seed: int = 1) -> DataFrame:
    """First parameters: for each feature and field, ``factors`` values in
    ``[0, 1 / sqrt(factors))`` by hash, so they do not depend on partitions."""
    seen = _seen(rows) if "features" in rows.columns else rows
    grid = seen.select("field", "index", F.explode(F.sequence(F.lit(0), F.lit(n_fields - 1))).alias("other"))
    unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), *_KEY, F.lit(i)), F.lit(1 << 30)) / float(1 << 30) / factors ** 0.5
    return grid.select(*_KEY, *[unit(i).alias(f"v{i}") for i in range(factors)], *[F.lit(0.0).alias(f"a{i}") for i in range(factors)])


def _by_feature(params: DataFrame, factors: int) -> DataFrame:
    """``field, index, v``: the vectors of each feature for fields 0, 1, ... in one array."""
    one = F.struct("other", F.array(*_columns("v", factors)).alias("v"))
    vectors = F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"]))
    return params.groupBy("field", "index").agg(vectors.alias("v"))


def _summed(packed: DataFrame, needed: DataFrame, params: DataFrame, n_fields: int, factors: int) -> DataFrame:
    """``field, index, g, loss``: each feature's gradient, summed over all rows (and, on
    the row with null field, the summed loss)."""
    width = n_fields * factors
    names = [f"g{i}" for i in range(width)]

    def part(rows: pa.Table, own: pa.Table) -> pa.Table:
        block = _Block(rows, own, factors, n_fields)
        grad, loss = block.gradient(rows.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        # the features with parameters, and a row for the loss
        field = [*block.names.field("field").take(pa.array(block.there)).to_pylist(), None]
        index = [*block.names.field("index").take(pa.array(block.there)).to_pylist(), None]
        grad = np.vstack([grad[block.there].reshape(len(block.there), width), np.zeros((1, width))])
        each = [pa.array(np.ascontiguousarray(grad[:, i])) for i in range(width)]
        total = pa.array(np.append(np.zeros(len(block.there)), loss))
        return pa.table([pa.array(field, pa.int32()), pa.array(index, pa.string()), *each, total], names=["field", "index", *names, "loss"])

    own = needed.join(params.select("field", "index", "v"), ["field", "index"]).select("block", "code", "v")
    schema = "field int, index string, " + ", ".join(f"{c} double" for c in (*names, "loss"))
    parts = packed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(part, schema)
    added = parts.groupBy("field", "index").agg(*[F.sum(c).alias(c) for c in (*names, "loss")])
    return added.select("field", "index", F.array(*names).alias("g"), "loss")


def gradients(blocks: DataFrame, needed: DataFrame, params: DataFrame, n_fields: int, factors: int) -> DataFrame:
    """``field, index, other, g0.., loss``: each parameter's gradient summed over all
    rows (and, on the row with null field, the summed loss)."""
    g = _summed(_packed(blocks), needed, _by_feature(params, factors), n_fields, factors)
    each = g.where("field is not null").select("field", "index", F.explode(F.sequence(F.lit(0), F.lit(n_fields - 1))).alias("other"), "g", "loss")
    long = each.select(*_KEY, *[F.get("g", F.col("other") * factors + i).alias(f"g{i}") for i in range(factors)], "loss")
    none = g.where("field is null").select("field", "index", F.lit(None).cast("int").alias("other"), *[F.lit(0.0).alias(f"g{i}") for i in range(factors)], "loss")
    return long.unionByName(none)


def fit(rows: DataFrame, n_fields: int, label: str = "is_trade", key: str = "instance_id", factors: int = 4, rounds: int = 10,
        rate: float = 0.3, reg: float = 1e-5, seed: int = 1) -> tuple[DataFrame, list[float]]:
    """``rows (key, label, features)`` -> the parameter table (``field, index``, vectors
    ``v``, squares ``a``) and the mean loss before every round."""
    seen = staged(_seen(rows), "ffm-seen")
    packed = staged(_packed(_dealt(rows, label, key, _most(seen), []), together=True), "ffm-packed")
    n = packed.agg(F.sum(F.size("key"))).first()[0] or 0
    needed = _needed(packed)
    params = _by_feature(start(seen, n_fields, factors, seed), factors).withColumn("a", F.transform("v", lambda _: F.lit(0.0)))
    params = staged(params, "ffm-parameters")
    losses = []
    for _ in range(rounds if n else 0):
        g = staged(_summed(packed, needed, params, n_fields, factors), "ffm-gradients")
        losses.append(g.where("field is null").first()["loss"] / n)
        own = g.where("field is not null").drop("loss")
        both = params.join(own, ["field", "index"], "left")
        slope = F.zip_with("v", F.coalesce("g", F.transform("v", lambda _: F.lit(0.0))), lambda v, x: x / n + v * reg)
        both = both.select("field", "index", "v", "a", slope.alias("s"))
        both = both.select("field", "index", "v", "s", F.zip_with("a", "s", lambda a, x: a + x * x).alias("a"))
        move = F.zip_with("s", "a", lambda x, a: rate * x / F.sqrt(a + 1e-12))
        both = both.select("field", "index", "v", "a", move.alias("m"))
        params = staged(both.select("field", "index", F.zip_with("v", "m", lambda v, m: v - m).alias("v"), "a"), "ffm-parameters")
    return params, losses


def predict(rows: DataFrame, params: DataFrame, n_fields: int, label: str | None = "is_trade", key: str = "instance_id", keep=()) -> DataFrame:
    """``key [label] predicted_score`` and the columns ``keep``."""
    factors = (params.agg(F.max(F.size("v"))).first()[0] or n_fields) // n_fields
    blocks = _dealt(rows, label, key, _most(params), list(keep))
    kinds = dict(blocks.dtypes)
    kept = ["key", "y", *[f"keep_{c}" for c in keep]]

    def part(rows: pa.Table, own: pa.Table) -> pa.Table:
        flat = lambda c: rows.column(c).combine_chunks().flatten()
        margin = _Block(rows, own, factors, n_fields).margins() if rows.num_rows else np.zeros(0)
        return pa.table({**{c: flat(c) for c in kept}, "p": pa.array(1 / (1 + np.exp(-margin)))})

    packed = staged(_packed(blocks, together=True), "ffm-packed")
    own = _needed(packed).join(params.select("field", "index", "v"), ["field", "index"]).select("block", "code", "v")
    out = packed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(part, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", p double")
    return out.select(F.col("key").alias(key), *([F.col("y").alias(label)] if label else []), F.col("p").alias("predicted_score"),
                      *[F.col(f"keep_{c}").alias(c) for c in keep])
