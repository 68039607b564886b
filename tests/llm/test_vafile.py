import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from clickfeat.llm import vafile as V


def brute(rows, queries, k):
    out = []
    for q, qv in queries:
        found = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(V, "VECTORS", 200)  # several blocks
    monkeypatch.setattr(V, "QUERIES", 7)
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in t.collect()]
    u = V.usable(t, "vec_id", "embedding", 256)
    assert result(V.top_k(u, u.where("id % 50 = 0"), 5)) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [1.0, None]), (7, []), (100, [1.0]), (8, [-3.0, 0.001]), (9, [0.0, 0.0]), (2, [1.0, 2.0]), (10, [5e14, -7e14]),
            (None, [9.0, 9.0]), (150, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in data], "vec_id long, embedding array<double>, id int, v string")
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in dict((i, v) for i, v in data if i is not None and v and
            all(x is not None and math.isfinite(x) for x in v)).items()]
    u = V.usable(df, "vec_id", "embedding", 256)
    assert result(V.top_k(u, u.where("id % 50 = 0"), 5)) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert result(V.top_k(u.limit(0), u.limit(0), 5)) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(1, 300), st.integers(0, 2 ** 31))
def test_block_search_is_exact(n, k, span, seed):
    r = np.random.default_rng(seed)
    v = r.integers(-span, span + 1, (n, 3))
    ids, got = r.permutation(n), defaultdict(list)
    for q, i, s in V.search_block(ids, v, ids[:5], v[:5], k):
        got[q].append((i, s))
    rows = list(zip(ids.tolist(), v.tolist()))
    want = brute(rows, rows[:5], k)
    assert sorted((q, i + 1, *x) for q, xs in got.items() for i, x in enumerate(xs)) == want
