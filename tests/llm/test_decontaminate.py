import re

from clickfeat.llm import decontaminate as D
from clickfeat.llm.queries import op9_decontaminate


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    places = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            places.setdefault(tuple(w[a:a + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, got = split(t), set(), set()
        for n in {len(p) for p in places}:
            for a in range(len(w) - n + 1):
                if ids := places.get(tuple(w[a:a + n])):
                    hit.update(range(a, a + n))
                    got |= ids
        out.append((d, len(w), len(hit), tuple(sorted(got))))
    return sorted(out, key=str)


def result(docs, items, window=10):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in D.decontaminate(docs, items, window).collect()), key=str)


def test_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(docs, items) == want and sum(r[2] > 0 for r in want) > 20


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


DOCS = [(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "... !!"), (5, "A a a a a a a a a a a a b a a"),
        (5, "A a a a a a a a a a a a b a a"), (6, "the cat SAT cat sat on"), (None, "cat sat"), (7, ("x1 " * 40000) + "cat sat"),
        (8, "two three four five six seven eight nine ten eleven twelve and three four five six seven eight nine ten eleven twelve thirteen")]
ITEMS = [(10, "Two, three four five six seven eight nine ten eleven twelve thirteen"), (11, "a a a a a a a a a a"), (12, "cat sat"),
         (13, None), (14, "?"), (None, "cat sat on"), (12, "sat on"), (15, "b"), (16, "a a a a a a a a a a a")]


def test_edges(spark, monkeypatch):
    docs = rows(spark, [(*r, 1, "z") for r in DOCS], "doc_id long, text string, matches int, item_id string")
    items = rows(spark, ITEMS, "item_id long, text string")
    want = brute(DOCS, [(i, t) for i, t in ITEMS if i is not None])
    assert result(docs, items) == want
    one = {str(r) for r in D.decontaminate(docs, items).collect()}
    left = sorted(map(str, D.clean(docs, items).collect()))
    monkeypatch.setattr(D, "PAIRS", 3)
    assert {str(r) for r in D.decontaminate(docs, items).collect()} == one
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)  # several blocks give the same
    several = D.decontaminate(docs, items)
    assert D._blocks(items, 10)[0] > 3 and result(docs, items) == want
    assert {str(r) for r in several.collect()} == one
    assert sorted(map(str, D.clean(docs, items).collect())) == left
    assert "MapInArrow" not in several._jdf.queryExecution().optimizedPlan().toString()  # no pass hangs on another
    assert D.clean(docs, items).columns == docs.columns
    assert {r[2] for r in result(docs, items.limit(0))} == {0}
    assert result(docs.limit(0), items) == []


def test_a_passage_of_many_items_and_documents(spark, monkeypatch):
    """40 words in 60 items and 80 documents: 31 windows of each meet, and one match of each stays."""
    passage = " ".join(f"w{i}" for i in range(40))
    docs = rows(spark, [(i, f"d{i} {passage} e{i}") for i in range(80)], "doc_id long, text string")
    items = rows(spark, [(i, f"i{i} {passage}") for i in range(60)] * 2, "item_id long, text string")
    monkeypatch.setattr(D, "PAIRS", 500)
    got = D.decontaminate(docs, items).collect()
    assert all(r.n_hit == 40 and sorted(r["items"]) == list(range(60)) and {tuple(m)[1:] for m in r.matches} == {(1, 1, 40)} and len(r.matches) == 60 for r in got)
    assert len(got) == 80 and D.clean(docs, items).count() == 0


def test_longest_matches_and_places(spark):
    docs = rows(spark, DOCS, "doc_id long, text string")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in D.decontaminate(docs, rows(spark, ITEMS[:1], "item_id long, text string")).collect()}
    assert got[1] == [(10, 0, 1, 10)]
    assert got[8] == [(10, 0, 0, 11), (10, 1, 12, 11)]


def test_clean_drops_hit_documents_only(spark):
    docs, items = rows(spark, DOCS, "doc_id long, text string"), rows(spark, ITEMS, "item_id long, text string")
    clean = [r[0] for r in result(docs, items) if not r[2]]  # rows without an id are judged like any
    assert sorted(str(r.doc_id) for r in D.clean(docs, items).collect()) == sorted(map(str, clean))


def test_query_digest(spark):
    import hashlib
    got = {r.items_sha256 for r in op9_decontaminate(spark, "/root/testdata/sf0.001").collect() if not r.contaminated}
    assert got == {hashlib.sha256(b"").hexdigest()}
