import re

import pytest
from pyspark.sql import functions as F

from clickfeat.llm.components import components
from clickfeat.llm.minhash import near_duplicates, one_of_each


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    """doc_id -> (set size, least reachable doc_id), all pairs compared."""
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    seen = set()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    same = len(sets[a] & sets[b])
                    if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def result(df, k):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, k).collect()}


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(docs, k) == brute([(r.doc_id, r.text) for r in docs.collect()], k)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, base), (7, base.upper() + " tail"),
            (8, "x " + base), (9, base + " " + " ".join(f"v{i}" for i in range(60))), (10, "é b " * 30000),
            (None, base), (11, "one"), (12, "one two three four five"), (13, "one two three four five six")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, component_id int")
    out = near_duplicates(df, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    want = brute([(d, t) for d, t in rows if d], 4)
    assert {d: v[:2] for d, v in got.items() if d} == want
    assert got[None] == (197, None, True)
    assert all(v[2] == (v[1] == d) for d, v in got.items() if d)
    assert near_duplicates(df.limit(0), 4).count() == 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (1, "q r s t u v")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df, 4).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1)]


def test_chain_of_links_is_one_component(spark):
    # neighbours are near copies, the ends are not
    w = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(w[i * 8:i * 8 + 100])) for i in range(20)], "doc_id long, text string")
    assert result(df, 4) == brute([(r.doc_id, r.text) for r in df.collect()], 4)


def test_components_of_a_path(spark):
    e = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.node, r.root) for r in components(e).collect()} == {(i, 0) for i in range(61)}


@pytest.mark.parametrize("block", [1024, 7])
def test_a_cloud_of_near_copies(spark, monkeypatch, block):
    """Copies with more and more changes: links lead away from any one hub."""
    import random

    from clickfeat.llm import minhash
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    r = random.Random(3)
    base, rows = [f"w{i}" for i in range(150)], []
    for d in range(160):
        w = list(base)
        for _ in range(r.choice([1, 3, 6, 8, 12, 30])):
            w[r.randrange(150)] = r.choice(["x", "y"]) + str(r.randrange(60))
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    assert result(df, 4) == want and 20 < len({v[1] for v in want.values()}) < 140


def test_one_row_of_each_group_whatever_the_ids(spark):
    text = lambda i: " ".join(f"t{i}w{j}" for j in range(60))
    near = lambda i: text(i) + " tail"
    rows = [(0, text(i)) for i in range(100)]  # a placeholder id: nothing in common
    rows += [(1, text(200)), (7, text(200)), (7, text(201)), (8, near(201))]  # 7 holds a copy and a text of its own
    rows += [(None, text(300)), (None, near(300)), (None, text(300)), (None, text(301)), (None, near(5)), (9, near(301))]
    rows += [(10, text(400)), (10, text(400)), (10, near(400)), (11, None), (11, None), (None, ""), (None, "")]
    df = spark.createDataFrame([(*r, {"a": i}, str(i)) for i, r in enumerate(rows)], "doc_id long, text string, node map<string,int>, __v string")
    out = one_of_each(df, 5)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    key = lambda r: (str(r[0]), str(r[1]))
    of_400 = [r for r in got if r[0] == 10]
    assert len(of_400) == 1
    of_300 = [r for r in got if r[1] in (text(300), near(300))]
    assert len(of_300) == 1
    want = rows[:100] + [(1, text(200)), (7, text(201)), (9, near(301)), (11, None), (11, None), (None, ""), (None, ""), *of_400, *of_300]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert one_of_each(df.limit(0), 5).count() == 0
