import corpus_pipeline as P
from clickfeat.llm import toxicity
from clickfeat.llm.common import fold, read
from clickfeat.llm.queries import PUBLIC_KEY, byte_bpe
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_packing import check as check_packing
from clickfeat.llm.pii import pseudonymise

D = "/root/testdata/sf0.01"


def test_every_stage_against_brute_force(spark):
    docs = read(spark, D, "documents")
    model = toxicity.learn(docs, read(spark, D, "labels"), fold("doc_id", 3) != 1)
    bad = {r.doc_id for r in toxicity.toxicity(docs, model).where("predicted = 1").collect()}
    want = {r.doc_id: tuple(r) for r in docs.collect() if r.doc_id not in bad}
    assert 0 < len(bad) < 200

    def stage(i, frame):
        out = P.STAGES[i][1](spark, frame, D).cache()
        assert out.columns == docs.columns
        return out, {r.doc_id: tuple(r) for r in out.collect()}

    one, got = stage(0, docs)
    assert got == want
    groups = brute_groups([(d, r[1]) for d, r in want.items()], 5)
    want = {d: r for d, r in want.items() if groups[d][1] == d}
    two, got = stage(1, one)
    assert got == want and len(want) < len(groups)
    items = [(r.item_id, r.text) for r in read(spark, D, "benchmark").collect()]
    want = {d: r for d, r in want.items() if not brute_hits([(d, r[1])], items)[0][2]}
    three, got = stage(2, two)
    assert got == want
    want = {d: (r[0], pseudonymise(r[1], PUBLIC_KEY)[0], *r[2:]) for d, r in want.items()}
    four, got = stage(3, three)
    assert got == want
    check_packing(P.STAGES[4][1](spark, four, D).collect(), [(d, r[1]) for d, r in want.items()])


def test_run_is_the_stages_in_a_row(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r.doc_id, r.start) for r in rows}) == len(rows)
    assert byte_bpe().endswith(".json")


def test_edges_go_through(spark, tmp_path):
    d = str(tmp_path)
    for t in ("labels", "benchmark"):
        read(spark, "/root/testdata/sf0.001", t).write.parquet(f"{d}/{t}.parquet")
    data = [(1, None, "en"), (2, "", None), (3, "same words here now again and again", "en"), (4, "same words here now again and again", "en"),
            (None, "no id at all", "en"), (5, "twice", "de"), (5, "twice", "de"), (6, "x " * 30_000, "xx"), (7, "mail a.b@c.example.com", "en")]
    docs = spark.createDataFrame([(*r, "s", 1, "clash", 2) for r in data],
                                 "doc_id long, text string, lang string, source string, n_chars long, node string, __v int")
    for name, stage in P.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, d)
            assert out.columns == docs.columns
            if name == "near_duplicates" and frame is docs:
                assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "5", "6", "7", "None"]
            else:
                assert out.count() == (len(data) if frame is docs else 0)
    assert P.pack(spark, docs.limit(0), d).count() == 0
