import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clickfeat.llm import toxicity as T


def toy(n=600, seed=0):
    r = np.random.default_rng(seed)
    words, texts, y = [f"w{i}" for i in range(200)], [], []
    for i in range(n):
        w = list(r.choice(words, r.integers(5, 40)))
        y.append(int(r.random() < 0.3))
        if y[-1]:
            w.insert(int(r.integers(len(w))), str(r.choice(["grr", "bah"])))
        texts.append(" ".join(w))
    return texts, y


def test_scores_equal_the_plain_convolution():
    model = T.Model(3)
    model.emb[:] = np.random.default_rng(1).normal(0, 1, model.emb.shape)
    texts = ["a b c d", "a", "", "b a " * 40, "x y"]
    code, first = T._hashed(pa.array(texts))
    got = model.logits(code, first)
    for t in range(len(texts)):
        a, b = T._pair(code[first[t]:first[t + 1]])
        x = np.concatenate([model.emb[a] + model.emb[b], np.zeros((2, T.DIM))])
        pooled = [np.max([sum(x[i + j] @ k[j] for j in range(len(k))) for i in range(len(a))], axis=0) if len(a) else np.zeros(T.FILTERS)
                  for k in model.conv]
        want = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.base
        np.testing.assert_allclose(got[t], want, rtol=1e-4, atol=1e-4)


def test_learns_a_planted_signal_and_edges(spark):
    texts, y = toy()
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, code int")
    labels = spark.createDataFrame([(i, t, 0) for i, t in enumerate(y)] + [(0, None, 0), (10_000, 1, 0), (1, 7, 0)], "doc_id long, toxic int, quality int")
    model = T.learn(docs, labels, F.col("doc_id") % 3 != 0)
    rows = T.toxicity(docs, model).where("doc_id % 3 = 0").collect()
    assert np.mean([r.predicted == y[r.doc_id] for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "grr"), (4, "w1 " * 50_000 + "bah"), (4, "w1 w2 w3")], "doc_id long, text string")
    got = T.toxicity(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id is None] == [1] and sorted(r.predicted for r in got if r.doc_id == 4) == [0, 1]
    assert T.toxicity(odd.limit(0), model).count() == 0
    assert sorted(r.text or "" for r in T.accepted(odd, model).collect()) == ["", "", "...", "w1 w2 w3"]


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "grr", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.toxicity(docs, T.learn(docs, none, F.lit(True))).collect()] == [0]


def test_threshold_is_the_best_cut():
    z, y = np.array([0.1, 0.4, 0.35, 0.8]), np.array([0.0, 0.0, 1.0, 1.0])
    assert 0.1 < T.best_threshold(z, y, np.ones(4)) < 0.35
    assert T.best_threshold(z, np.zeros(4), np.ones(4), 3.0) == 3.0


def test_the_sample_is_bounded_by_ids_and_words_not_rows(spark, monkeypatch):
    texts, y = toy(60)
    rows = [(0, f"{texts[0]} {i}", "en") for i in range(5000)] + [(1, "grr", "en")] * 15_000
    rows += [(i, t, None) for i, t in enumerate(texts) if i > 1] + [(2, None, "en"), (3, "x" * (T.SAMPLE_BYTES + 1), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    own = spark.createDataFrame([(i, 1 if i == 1 else t) for i, t in enumerate(y)], "doc_id long, toxic int")
    got = T.sample(docs, own).collect()
    assert sorted(r.doc_id for r in got) == list(range(60))
    # whatever the partitions, the same row of each id
    again = T.sample(docs.coalesce(1), own).collect()
    assert {(r.doc_id, tuple(r.code)) for r in got} == {(r.doc_id, tuple(r.code)) for r in again}
    monkeypatch.setattr(T, "SAMPLE_WORDS", 200)
    few = T.sample(docs, own).collect()
    for t in (0, 1):
        words = [len(r.code) for r in few if r.toxic == t]
        assert words and sum(words) <= 200
    assert T.sample(docs.limit(0), own).count() == 0


def test_learns_from_all_rows_not_from_a_sample(spark, monkeypatch):
    # the words that tell are only in documents that a bounded sample leaves out: beyond its ids, and in long texts
    for name, bound in (("SAMPLE", 20), ("SAMPLE_BYTES", 300), ("SAMPLE_WORDS", 400)):
        monkeypatch.setattr(T, name, bound)
    monkeypatch.setattr(T, "TASK_ROWS", 150)  # several tasks
    texts, y = toy(900, 4)
    texts = [x if i % 2 else x + " pad" * 200 for i, x in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    model = T.learn(docs, labels, F.col("doc_id") % 3 != 0)
    rows = T.toxicity(docs, model).where("doc_id % 3 = 0").collect()
    assert np.mean([r.predicted == y[r.doc_id] for r in rows]) > 0.95


def test_counts_are_of_all_rows(spark):
    texts, y = toy(80)
    rows = spark.createDataFrame([(t, True, "en" if i % 2 else "de", x) for i, (x, t) in enumerate(zip(texts, y))],
                                 "toxic int, calibrates boolean, lang string, text string").repartition(5)
    seen, by_language = T.counted(rows.mapInArrow(T._coded, "toxic int, calibrates boolean, lang string, code array<int>"), ["de", "en"])
    code, first = T._hashed(pa.array(texts))
    want, words = np.zeros(seen.shape), np.zeros((T.BUCKETS, 2))
    for d, t in enumerate(y):
        a, b = T._pair(code[first[d]:first[d + 1]])
        want[t, np.unique(a)] += 1
        want[t, np.unique(b)] += 1
        np.add.at(words[:, d % 2], a, 1)
    assert (seen == want).all() and (by_language == words).all()


def test_thresholds_over_a_table_are_the_best_cuts(spark):
    r = np.random.default_rng(2)
    rows = [(int(g), float(np.round(r.normal(), d)), int(r.random() < 0.3)) for g, d in ((0, 1), (1, 3), (2, 6)) for _ in range(400)]
    rows += [(3, 1.0, 0)] * 5 + [(4, 100.0 + i, int(i % 3 == 0)) for i in range(9)] + [(5, 0.5, 1)] * 3
    got = T.thresholds(spark.createDataFrame(rows, "own long, z double, y int").repartition(7))
    for g in range(6):
        z, y = (np.array([x[i] for x in rows if x[0] == g], float) for i in (1, 2))
        assert got.get(g, 7.0) == T.best_threshold(z, y, np.ones(len(z)), 7.0)


def test_a_long_text_is_worked_in_parts(monkeypatch):
    model, (code, first) = T.Model(3), T._hashed(pa.array(["a b c d e f g h i j " * 7 + "k"]))
    model.emb[:] = np.random.default_rng(1).normal(0, 1, model.emb.shape)
    whole = model._pooled(code, first)
    monkeypatch.setattr(T, "LONG", 8)
    parts = model._pooled(code, first)
    np.testing.assert_allclose(parts[0], whole[0], rtol=1e-5)
    assert (parts[1] == whole[1]).all()


def test_the_driver_gets_means_of_met_buckets_only(spark):
    texts, y = toy(90)
    rows = spark.createDataFrame([(t, False, "en", x) for x, t in zip(texts, y)], "toxic int, calibrates boolean, lang string, text string").repartition(3)
    rows = rows.mapInArrow(T._coded, "toxic int, calibrates boolean, lang string, code array<int>")
    model, last = T.Model(3), 2 * T.BUCKETS // T.BLOCK
    shared = spark.sparkContext.broadcast(model)
    sums = {k: np.frombuffer(v) for k, v in T._added(rows, T._descent(shared, 0), np.float32).items()}
    means = T._added(rows, T._descent(shared, 0), np.float32, T._averaged)
    met = sum(int((v.reshape(T.BLOCK, -1)[:, -1] > 0).sum()) for k, v in sums.items() if k < last)
    assert 0 < met < 1000
    assert sum(len(v) for k, v in means.items() if k < last) == met * 4 * (2 * T.DIM + 1)
    emb, squares = model.emb.copy(), model.squares.copy()
    for k, v in sums.items():
        if k < last:
            v, at = v.reshape(T.BLOCK, -1), slice(k * T.BLOCK, (k + 1) * T.BLOCK)
            emb[at] += (v[:, :T.DIM] / np.maximum(v[:, -1:], 1)).astype(np.float32)
            squares[at] += (v[:, T.DIM:-1] / np.maximum(v[:, -1:], 1)).astype(np.float32)
    model.merge(means)
    assert (model.emb == emb).all() and (model.squares == squares).all()
    assert len(pickle.dumps(model.fitted())) < 1.1 * model.emb.nbytes
    assert (model.fitted().scores(*T._hashed(pa.array(texts))) == model.scores(*T._hashed(pa.array(texts)))).all()
