"""Field-aware factorisation: gradient against finite differences, a planted interaction, odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from clickfeat.operators import fieldaware as FA

SCHEMA = f"instance_id long, is_trade int, features {FA.FEATURE}"


def planted(n, seed=4):
    """The label hangs on whether fields 0 and 1 agree; field 2 is noise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(6), rng.randrange(6), rng.randrange(9)
        y = int(rng.random() < (0.9 if (a + b) % 2 else 0.1))
        rows.append((i, y, [(0, str(a)), (1, str(b)), (2, str(c))]))
    return rows


def loss(rows, w, k):
    """Mean loss by the definition, feature pair by feature pair."""
    total = 0.0
    for _, y, f in rows:
        m = sum(float(np.dot(w[(*f[a], f[b][0])], w[(*f[b], f[a][0])])) for a in range(len(f)) for b in range(a + 1, len(f))) / max(len(f), 1)
        total += math.log1p(math.exp(-m if y else m))
    return total


def test_gradient_equals_finite_differences(spark, monkeypatch):
    rows = planted(40) + [(40, 1, [(0, "1"), (0, "2"), (0, "2"), (1, "3")]), (41, 0, []), (42, 1, [(2, "1")])]
    monkeypatch.setattr(FA, "BLOCK_ROWS", 9)  # several blocks, sums over them
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks = FA._blocks(df, "is_trade", "instance_id")
    params = FA.start(blocks, 3, 2).collect()
    w = {(r.field, r["index"], r.other): np.array([r.v0, r.v1]) for r in params}
    table = spark.createDataFrame(params)
    got = FA.gradients(blocks, FA._needed(blocks), table, 3, 2).collect()
    assert blocks.select("block").distinct().count() > 1
    assert abs(next(r.loss for r in got if r.field is None) - loss(rows, w, 2)) < 1e-9
    seen = [r for r in got if r.field is not None]
    assert len(seen) == len(w)
    for r in random.Random(1).sample(seen, 12):
        for i, g in enumerate((r.g0, r.g1)):
            key, step = (r.field, r["index"], r.other), 1e-6
            w[key][i] += step
            up = loss(rows, w, 2)
            w[key][i] -= 2 * step
            down = loss(rows, w, 2)
            w[key][i] += step
            assert abs((up - down) / (2 * step) - g) < 1e-6


def log_loss(scored):
    p = F.when(F.col("is_trade") == 1, F.col("predicted_score")).otherwise(1 - F.col("predicted_score"))
    return scored.select(F.avg(-F.log(p))).first()[0]


def test_learns_a_planted_field_interaction(spark):
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    train, hold = (spark.createDataFrame(planted(n, s), SCHEMA) for n, s in ((3000, 1), (800, 2)))
    params, losses = FA.fit(train, 3, factors=4, rounds=12, rate=0.5)
    assert losses[-1] < losses[0] and losses[-1] < 0.5
    scored = FA.predict(hold, params, 3)
    assert scored.count() == 800
    va = VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="x")
    plain = lambda d: va.transform(d.select("is_trade", *[F.col("features")[i]["index"].cast("double").alias(f"f{i}") for i in range(3)]))
    fm = FMClassifier(featuresCol="x", labelCol="is_trade", factorSize=4, maxIter=30, stepSize=0.05, seed=1).fit(plain(train))
    other = log_loss(fm.transform(plain(hold)).select("is_trade", vector_to_array("probability")[1].alias("predicted_score")))
    assert log_loss(scored) < min(0.5, other - 0.1, math.log(2) - 0.1)


def test_odd_rows(spark):
    rows = [(1, None, None), (1, 1, [(0, "a"), (1, None)]), (None, 0, []), (2, 0, [(0, "a"), (1, "é")])]
    df = spark.createDataFrame(rows, SCHEMA)
    params, losses = FA.fit(df, 2, factors=2, rounds=2)
    new = spark.createDataFrame([(5, None, [(0, "never"), (1, "seen")]), (6, 1, None)], SCHEMA)
    assert {r.instance_id: r.predicted_score for r in FA.predict(new, params, 2).collect()} == {5: 0.5, 6: 0.5}
    assert FA.predict(df, params, 2).count() == 4 and len(losses) == 2
    assert FA.fit(df.limit(0), 2, rounds=2)[1] == [] and FA.predict(df.limit(0), params, 2).count() == 0


def test_a_value_is_in_few_blocks_and_a_hot_one_is_cut(spark, monkeypatch):
    monkeypatch.setattr(FA, "BLOCK_ROWS", 100)
    rows = [(i, i % 2, [(0, str(i % 3)), (1, str(i % 200) if i < 1000 else "hot")]) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    blocks = FA._blocks(df, "is_trade", "instance_id", FA._most(FA._seen(df)))
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) > 5 and max(sizes) < 1000
    # 201 values, and one more for each cut; dealt at random each of the 20 blocks has nearly 50
    assert FA._needed(blocks).where("field = 1").count() <= 201 + len(sizes)


def test_tables_of_combinations_and_rows_give_one_gradient(spark, monkeypatch):
    import pyarrow as pa
    rng = random.Random(7)
    rows = []
    for i in range(300):  # two fields of one feature, two of up to four, some missing or without index
        f = [(0, str(rng.randrange(40))), (3, str(rng.randrange(3)))][rng.randrange(-1, 1) if i % 9 else 2:]
        f += [(n, rng.choice(["a", "b", "c", None])) for n in (1, 2) for _ in range(rng.randrange(4))]
        rows.append({"block": 0, "key": i, "y": i % 2, "features": [dict(field=a, index=b) for a, b in f]})
    kind = pa.list_(pa.struct([("field", pa.int32()), ("index", pa.string())]))
    table = pa.Table.from_pylist(rows, pa.schema([("block", pa.int32()), ("key", pa.int64()), ("y", pa.int32()), ("features", kind)]))
    packed = FA._pack(table)
    names = packed.column("names").combine_chunks().flatten().to_pylist()
    w = np.random.default_rng(2).normal(size=(len(names), 4, 2))
    own = pa.table({"code": pa.array(range(len(names)), pa.int32()), "v": pa.array([list(x.ravel()) for x in w], pa.list_(pa.float64()))})
    y = np.array([r["y"] for r in rows])
    found = []
    for table_rows in (0, 1e9):
        monkeypatch.setattr(FA, "TABLE_ROWS", table_rows)
        block = FA._Block(packed, own, 2, 4)
        found.append((block.margins(), *block.gradient(y)))
    assert all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(*found))
    vectors = {(n["field"], n["index"], g): w[i, g] for i, n in enumerate(names) for g in range(4)} | {(f, None, g): np.zeros(2) for f in range(4) for g in range(4)}
    want = loss([(r["key"], r["y"], [(f["field"], f["index"]) for f in r["features"]]) for r in rows], vectors, 2)
    assert abs(found[0][2] - want) < 1e-9


def test_scores_keep_columns_and_rows_of_equal_keys(spark):
    rows = [(i // 2, i % 2, [(0, str(i % 3))], 20 + i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA + ", day int")
    params, _ = FA.fit(df, 1, factors=2, rounds=1)
    got = FA.predict(df, params, 1, keep=["day"])
    assert sorted((r.instance_id, r.is_trade, r.day) for r in got.collect()) == sorted((r[0], r[1], r[3]) for r in rows)
