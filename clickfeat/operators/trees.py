"""A fitted tree ensemble as a table and as SQL.

``tree_table`` lists every leaf with the predicates of its path, so a model can
be kept, read and checked as data; ``leaf_columns`` and ``score_column`` give
the leaf of every tree and the ensemble's score as nested ``CASE`` expressions
on the feature columns: the same result as the trainer's own transform, with
no model object on the executors.

Leaves are numbered from the left, as the trainer numbers them.  Missing
values are -1, as in training.  The ensemble has trees x 2^depth nodes, a bound
set by its parameters, and only it is walked on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLE = "tree int, leaf int, weight double, prediction double, path array<struct<feature:string,op:string,threshold:double>>"


def _walk(node, features: list[str], path: tuple):
    """Leaves from the left: ``(path, prediction)``."""
    if not node.getClass().getSimpleName().startswith("InternalNode"):
        yield path, float(node.prediction())
        return
    split = node.split()
    name, at = features[split.featureIndex()], float(split.threshold())
    yield from _walk(node.leftChild(), features, (*path, (name, "<=", at)))
    yield from _walk(node.rightChild(), features, (*path, (name, ">", at)))


def leaves(model: PipelineModel, features: list[str]) -> list[list]:
    """Per tree its weight and its leaves from the left."""
    gbt = model.stages[-1]
    return [(float(w), list(_walk(t._java_obj.rootNode(), features, ()))) for t, w in zip(gbt.trees, gbt.treeWeights)]


def tree_table(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    rows = [(t, i, w, p, list(path)) for t, (w, tree) in enumerate(leaves(model, features)) for i, (path, p) in enumerate(tree)]
    return spark.createDataFrame(rows, TABLE)


def _value(feature: str) -> str:
    return f"coalesce(CAST(`{feature}` AS DOUBLE), -1D)"


def _case(tree: list, what) -> str:
    """The tree as nested CASE; ``what(leaf, prediction)`` gives a leaf's SQL."""
    def node(part, depth):
        if len(part) == 1:
            i, (_, prediction) = part[0]
            return what(i, prediction)
        feature, _, at = part[0][1][0][depth]
        left = [x for x in part if x[1][0][depth] == (feature, "<=", at)]
        right = [x for x in part if x[1][0][depth] == (feature, ">", at)]
        return f"CASE WHEN {_value(feature)} <= {at!r}D THEN {node(left, depth + 1)} ELSE {node(right, depth + 1)} END"
    return node(list(enumerate(tree)), 0)


def leaf_columns(model: PipelineModel, features: list[str], prefix: str = "xgb_") -> list[Column]:
    """The leaf of every tree, ``prefix1, prefix2, ...``."""
    return [F.expr(f"CAST({_case(tree, lambda i, _: str(i))} AS INT)").alias(f"{prefix}{t + 1}") for t, (_, tree) in enumerate(leaves(model, features))]


def score_column(model: PipelineModel, features: list[str]) -> Column:
    """The ensemble's probability of class 1."""
    margin = " + ".join(f"{w!r}D * ({_case(tree, lambda _, p: f'{p!r}D')})" for w, tree in leaves(model, features))
    return (1 / (1 + F.exp(-2 * F.expr(f"({margin})")))).alias("predicted_score")


def path_checks(df: DataFrame, table: DataFrame, leaf_names: list[str], keep=()) -> DataFrame:
    """``keep`` and ``other_paths``: for each row, of the leaves in ``leaf_names`` (a column a tree) those that ``table``
    (``tree_table``) does not have, or whose path has a predicate that the row breaks.

    The table has trees x 2^depth rows, a bound set by the model's parameters; a task gets it as arrays, so a
    row costs a look-up for each tree and step, and only the features that the table names are read."""
    found = table.collect()
    names = sorted({p["feature"] for r in found for p in r["path"]})
    place = {n: i for i, n in enumerate(names)}
    shape = len(leaf_names), 1 + max((r["leaf"] for r in found), default=0)
    deep = max((len(r["path"]) for r in found), default=0)
    known, steps = np.zeros(shape, bool), np.zeros(shape, np.int64)
    feature, threshold, left = (np.zeros((*shape, deep), t) for t in (np.int64, np.float64, bool))
    for r in found:
        at = r["tree"], r["leaf"]
        known[at], steps[at] = True, len(r["path"])
        for i, p in enumerate(r["path"]):
            feature[(*at, i)], threshold[(*at, i)], left[(*at, i)] = place[p["feature"]], p["threshold"], p["op"] == "<="

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = np.array([b.column(f"__x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))], np.float64).reshape(len(names), n)
            x, row, bad = np.where(np.isnan(x), np.inf, x), np.arange(n), np.zeros(n, np.int64)  # NaN is above all numbers
            for t, name in enumerate(leaf_names):
                leaf = b.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
                own = np.clip(leaf, 0, shape[1] - 1)
                broken = (leaf != own) | ~known[t, own]
                for i in range(deep):
                    broken |= (i < steps[t, own]) & ((x[feature[t, own, i], row] <= threshold[t, own, i]) != left[t, own, i])
                bad += broken
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(bad)], [*keep, "other_paths"])

    values = [F.coalesce(F.col(n).cast("double"), F.lit(-1.0)).alias(f"__x{i}") for i, n in enumerate(names)]
    rows = df.select(*keep, *[c for c in leaf_names if c not in keep], *values)
    return rows.mapInArrow(run, df.select(*keep, F.lit(0).cast("bigint").alias("other_paths")).schema)
