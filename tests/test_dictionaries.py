"""Code tables, positions of files, strict rates, feature dictionary, vocabulary ranks."""

import random

import pytest
from pyspark.sql import functions as F

from clickfeat.operators import encode as EN
from clickfeat.operators import ffm as FF
from clickfeat.operators import ordered as O
from clickfeat.operators import rates as RT
from clickfeat.operators import rows as R
from clickfeat.operators import vocab as V
from clickfeat.session import scratch_path
from clickfeat.sources import positions as POS


def first_seen(rows):
    """Codes by walking the rows in order (missing values first)."""
    codes = {}
    for t, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        codes.setdefault(v, len(codes) + 1)
    return {(t, i): codes[v] for t, i, v in rows}


@pytest.mark.parametrize("kind,make", [("long", lambda r: r.choice([None, -5, r.randrange(400)])), ("string", lambda r: r.choice([None, "", "it's", f"é{r.randrange(300)}"])),
                                       ("double", lambda r: r.choice([None, 0.5, r.randrange(9) / 3]))])
@pytest.mark.parametrize("literal,broadcast", [(128, 16 << 20), (0, 16 << 20), (0, 0)])
def test_codes_by_map_broadcast_and_join(spark, monkeypatch, kind, make, literal, broadcast):
    monkeypatch.setattr(EN, "LITERAL_CODES", literal)
    monkeypatch.setattr(EN, "BROADCAST_BYTES", broadcast)
    rng = random.Random(7)
    rows = [(rng.choice([None, -3, 1, 2, 3, 1 << 40]), i, make(rng)) for i in range(300)]
    df = spark.createDataFrame(rows, f"t long, i long, v {kind}")
    got = {(r.t, r.i): r.v_code for r in EN.first_seen_codes(df, ["v"], ["t", "i"], "_code").collect()}
    assert got == first_seen(rows)
    assert EN.first_seen_codes(df.limit(0), ["v"], ["t", "i"], "_code").collect() == []


def test_day_by_day_codes_are_those_of_all_days(spark):
    rng = random.Random(1)
    rows = [(day * 100 + i, day * 50 + i, rng.choice([None, *range(4 + 3 * day)])) for day in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "t long, i long, v long").withColumn("w", F.col("v").cast("string"))
    codes = None
    for day in range(4):
        before = {} if codes is None else {(r.field, r.v): r.code for r in codes.collect()}
        codes = EN.extended_codes(codes, df.where((F.col("t") >= day * 100) & (F.col("t") < day * 100 + 100)), ["v", "w"], ["t", "i"])
        assert before.items() <= {(r.field, r.v): r.code for r in codes.collect()}.items()
    got = {(r.t, r.i): r.v_code for r in EN.coded(df, codes, ["v", "w"]).collect()}
    assert got == first_seen(rows)
    new = spark.createDataFrame([(1, 1, 999, "x")], "t long, i long, v long, w string")
    assert EN.coded(new, codes, ["v", "w"]).first()["v_code"] is None


def test_positions_of_many_files_and_splits(spark):
    lines = [f"{i * 37 % 1000} row" for i in range(5000)]
    path = scratch_path(spark, "many-files")
    spark.createDataFrame(list(enumerate(lines)), "i long, s string").repartitionByRange(4, "i").sortWithinPartitions("i").select("s").write.text(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "3k"):  # several files in a partition, several splits of a file
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = POS.with_positions(spark.read.text(path))
            assert [r["value"] for r in got.orderBy("position").collect()] == lines
            assert [r["position"] for r in got.orderBy("position").collect()] == list(range(5000))
        first = R.dedup_first(got.withColumn("k", F.split("value", " ")[0]), ["k"], ["position"])
        assert {(r.k, r.position) for r in first.collect()} == {(s.split(" ")[0], i) for i, s in enumerate(lines[:1000])}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    empty = scratch_path(spark, "no-rows")
    spark.createDataFrame([], "s string").write.text(empty)
    assert POS.with_positions(spark.read.schema("value string").text(empty)).collect() == []


def test_strict_rates_of_a_hot_item_in_chunks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(40)]), rng.choice([None, 0, 1])) for i in range(300)]
    df = spark.createDataFrame(rows, "instance_id long, item_id long, context_timestamp long, is_trade int")
    want = {}
    for i, item, t, _ in rows:
        earlier = [y or 0 for _, other, s, y in rows if item is not None and other == item and None not in (s, t) and s < t]
        want[i] = (None, None) if item is None or t is None else (len(earlier), sum(earlier))
    for size in (O.CHUNK_ROWS, 6):
        got = RT.add_strict_rates(df, {"item_id": "item"}, chunk_rows=size).collect()
        assert {r.instance_id: (r.item_before, r.trade_item_before) for r in got} == want and len(got) == 300


def test_dictionary_fields_without_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([("a", "1", 4, 6, 10, 0.6), ("a", "2", 2, 18, 20, 0.9), ("l", "x", 9, 1, 10, 0.1), ("l", "y", 3, 0, 3, 0.0)],
                                  "Field string, Value string, Neg long, Pos long, Total long, Ratio double")
    numbers, n = FF.feature_dictionary(table, 5, k=2)
    assert n == 5 and {(r.Field, r.Value, r.num) for r in numbers.collect()} == {("a", "1", 5), ("a", "2", 6), ("l", "x", 7), ("a", "2", 8), ("a", "1", 9)}
    df = spark.createDataFrame([(1, 2, ["x", "y"]), (2, None, None), (3, 1, [])], "instance_id long, a int, l array<string>")
    want = {1: [6, 7, 8], 3: [5, 9]}
    for size in (16 << 20, 0):
        monkeypatch.setattr(FF, "BROADCAST_BYTES", size)
        assert {r.instance_id: r.fields for r in FF.dictionary_fields(df, numbers, ["l"], ["a"]).collect()} == want


def test_ranks_in_a_large_vocabulary(spark):
    vocab = [f"t{i * 7919 % 3001}" for i in range(3000)]
    rows = [(["t5", "t5", "nothing", vocab[2999], vocab[0]],), ([],), (None,), ([None, vocab[17]],)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = df.select(V.overlap_ranks(F.col("t"), vocab).alias("r"), V.overlap_count(F.col("t"), vocab).alias("n")).collect()
    assert [r.r for r in got] == [sorted([vocab.index("t5"), 2999, 0]), [], None, [17]] and [r.n for r in got][:2] == [3, 0]
    assert df.select(V.overlap_ranks(F.col("t"), []).alias("r")).first().r == []


def _words(spark, rows):
    return spark.createDataFrame(rows, "t array<string>, is_trade int").repartition(6)


def test_heavy_tokens_equal_exact_counts_and_count_few_on_zipf_data(spark):
    # word i some 60,000 / (i + 1) times: a long tail of words that occur once or twice
    words = [f"w{i:05d}" for i in range(30000) for _ in range(max(1, 60000 // (i + 1) // 8))]
    random.Random(5).shuffle(words)
    df = _words(spark, [(words[i:i + 50], i % 3 == 0 and 1 or 0) for i in range(0, len(words), 50)])
    specs = {"a": (F.col("t"), 20, False), "p": (F.col("t"), 5, True)}
    got = V.heavy_tokens(df, specs).collect()
    for v, (col, k, pos) in specs.items():
        exact = [tuple(r) for r in V.topk_tokens(df, col, k, pos).collect()]
        own = sorted((r for r in got if r["v"] == v), key=lambda r: r["rnk"])
        assert [(r["token"], r["cnt"]) for r in own] == exact and [r["rnk"] for r in own] == list(range(k))
        assert all(r["cnt"] >= r["others_below"] > 0 for r in own)
        assert own[0]["counted"] < 3000  # a tenth of the words at most


def test_heavy_tokens_fall_back_to_exact_counts_on_flat_data_and_ties(spark):
    df = _words(spark, [([f"w{i:04d}", f"w{(i * 7) % 3000:04d}"], 0) for i in range(3000)])
    got = sorted(V.heavy_tokens(df, {"a": (F.col("t"), 40, False)}).collect(), key=lambda r: r["rnk"])
    assert [(r["token"], r["cnt"]) for r in got] == [(f"w{i:04d}", 2) for i in range(40)]  # all tied: by token
    assert got[0]["counted"] == 3000


def test_heavy_tokens_of_short_null_and_empty_lists(spark):
    df = _words(spark, [(["x", None, "x"], 1), (None, 1), ([], 0), (["y", None, None], 0)])
    specs = {"a": (F.col("t"), 10, False), "p": (F.col("t"), 1, True), "none": (F.when(F.lit(False), F.col("t")), 3, False)}
    got = sorted((r["v"], r["rnk"], r["token"], r["cnt"]) for r in V.heavy_tokens(df, specs).collect())
    assert got == [("a", 0, None, 3), ("a", 1, "x", 2), ("a", 2, "y", 1), ("p", 0, "x", 2)]
    assert V.heavy_tokens(df.limit(0), specs).count() == 0


@pytest.mark.parametrize("literal,broadcast", [(4096, 16 << 20), (0, 16 << 20), (0, 0)])
def test_dictionary_fields_without_listing_pairs(spark, monkeypatch, literal, broadcast):
    monkeypatch.setattr(FF, "LITERAL_VALUES", literal)
    monkeypatch.setattr(FF, "BROADCAST_BYTES", broadcast)
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(1, 30)]), rng.choice([None, "x", "07", "7", ""]), rng.choice([None, [], [1, 2], [5, 900], [3, None]])) for i in range(200)]
    df = spark.createDataFrame(rows, "instance_id long, a long, b string, l array<int>")
    known = [("a", str(v), 10 + v) for v in range(0, 40, 2)] + [("a", "4", 99), ("b", "x", 60), ("b", "07", 61), ("l", "2", 70), ("l", "900", 71), ("l", "2", 98), ("z", "1", 5)]
    dictionary = spark.createDataFrame(known, "Field string, Value string, num long")
    want = {}
    for i, a, b, ls in rows:
        met = [("a", str(a))] * (a is not None) + [("b", b)] * (b is not None) + [("l", str(x)) for x in ls or [] if x is not None]
        want[i] = sorted(n for f, v, n in known if (f, v) in met)
    out = FF.with_dictionary_fields(df, dictionary, ["l"], ["a", "b"])
    assert {r.instance_id: r.fields for r in out.collect()} == want and out.columns == [*df.columns, "fields"]
    codes = FF.with_dictionary_fields(df.drop("b"), dictionary, ["l"], ["a"])
    if literal:  # constants of the plan: nothing is listed, joined or grouped
        plan = codes._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Generate", "Join", "Aggregate"))
    assert FF.with_dictionary_fields(df, dictionary.limit(0), ["l"], ["a", "b"]).where("size(fields) = 0").count() == 200


def test_online_lines_and_the_count_of_their_last_fields(spark):
    rows = [(1, 0, [3, 4], 7, [30, 41], 2), (2, 1, [], None, [], 5), (3, 1, None, 9, [30], None), (4, 0, [None], 1, [31], 0)]
    df = spark.createDataFrame(rows, "instance_id long, y int, l array<int>, a long, fields array<bigint>, leaf int")
    lines = FF.ffm_rows_online(df, "y", ["l"], ["a"], 50, ["leaf"])
    assert [r.line for r in lines.orderBy("instance_id").collect()] == [
        "0 0:3:1 0:4:1 1:7:1 30:1:1 41:1:1 50:2:1 ", "1 50:5:1 ", "1 1:9:1 30:1:1 ", "0 1:1:1 31:1:1 50:0:1 "]
    texts = ["", "99", "1 50:2:1 ", "0 1:1:1  51:1:1 x50:1:1 60 70", "0 50:5:1 51:1:1", "1 99999999999:1:1 4294967296:1:1 2147483647:1:1 :1:1 5a:1:1 ", None, "é 61:ü:1 62:1:1 "]
    t = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, value string").coalesce(1)
    found = {r.i: r.n for r in FF.fields_above(t, "value", 50, "n").collect()}
    tokens = F.filter(F.slice(F.split("value", " "), 2, 1 << 20), lambda x: (x != "") & (F.substring_index(x, ":", 1).try_cast("int") > 50))
    assert found == {r.i: max(r.n, 0) for r in t.select("i", F.coalesce(F.size(tokens), F.lit(0)).alias("n")).collect()}
    assert FF.fields_above(t.limit(0), "value", 50, "n").collect() == []


def test_sizes_of_few_integers_are_looked_up_and_others_joined(spark, monkeypatch):
    from clickfeat.operators import counts as C
    rng = random.Random(9)
    rows = [(i, rng.choice([None, -3, 0, 2000]), rng.choice([None, 1 << 40, -(1 << 40), 5]), rng.choice([None, "a", "b"]), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "instance_id long, a int, b long, c string, is_trade int")
    groups = {"n_a": ["a"], "n_b": ["b"], "n_c": ["c"], "n_ac": ["a", "c"]}
    for literal in (4096, 0):
        monkeypatch.setattr(EN, "LITERAL_RANGE", literal)
        monkeypatch.setattr(C, "LITERAL_RANGE", literal)
        out = C.add_group_sizes(df, groups, population=df, label="is_trade", trades={"n_a": "t_a", "n_b": "t_b"})
        joins = out._jdf.queryExecution().optimizedPlan().toString().count("Join")
        assert joins == (3 if literal else 4)
        for r in out.collect():
            same = lambda *k: [x for x in rows if all(x[i] == rows[r.instance_id][i] for i in k)] if None not in [rows[r.instance_id][i] for i in k] else None
            for name, k in (("n_a", [1]), ("n_b", [2]), ("n_c", [3]), ("n_ac", [1, 3])):
                assert r[name] == (None if same(*k) is None else len(same(*k)))
            for name, k in (("t_a", 1), ("t_b", 2)):
                assert r[name] == (None if same(k) is None else (sum(x[4] for x in same(k)) or None))
