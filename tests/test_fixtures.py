"""Hand-made micro-fixtures (FIXTURES.md §4) for parsing, windows, flags,
rates, bins, hashing, encoding and sampling edge cases."""

from pyspark.sql import functions as F, types as T

from clickfeat.functions import lists as L
from clickfeat.operators import counts as C
from clickfeat.operators import encode as EN
from clickfeat.operators import prior as PR
from clickfeat.operators import rates as RT
from clickfeat.operators import sample as SMP
from clickfeat.operators import vocab as V
from clickfeat.operators import windows as W


def test_nested_parse(spark):
    df = spark.createDataFrame([("a:1,2;b:-1;-1;c",)], ["s"])
    r = df.select(L.predict_categories("s").alias("c"), L.predict_properties("s").alias("p")).first()
    assert r["c"] == ["a", "b"] and r["p"] == ["1", "2"]


def test_token_between_first_and_second_colon(spark):
    df = spark.createDataFrame([("x:1:2;y:",)], ["s"])
    r = df.select(L.predict_categories("s").alias("c"), L.predict_properties("s").alias("p")).first()
    assert r["c"] == ["x", "y"] and r["p"] == ["1", ""]


def test_missing_third_level(spark):
    df = spark.createDataFrame([("7;8",)], ["s"])
    r = df.select(*[L.category_level("s", i).alias(f"c{i}") for i in range(3)]).first()
    assert (r["c0"], r["c1"], r["c2"]) == (7, 8, -1)


def test_predicted_category_missing(spark):
    df = spark.createDataFrame([("5:p;6:-1",)], ["s"])
    r = df.select(*[L.predicted_category("s", i).alias(f"c{i}") for i in range(3)]).first()
    assert (r["c0"], r["c1"], r["c2"]) == (5, 6, -1)


def test_repeated_token(spark):
    df = spark.createDataFrame([("p;p;q", 1)], ["s", "is_trade"])
    tok = L.tokens("s")
    top = {r["token"]: r["cnt"] for r in V.topk_tokens(df, tok, 10).collect()}
    assert top == {"p": 2, "q": 1}
    r = df.select(V.overlap_count(tok, ["p", "q"]).alias("n"), L.property_count("s").alias("k"),
                  V.overlap_string(tok, ["q", "p"]).alias("s")).first()
    assert (r["n"], r["k"], r["s"]) == (2, 3, "p;q")


def _clicks(spark, rows):
    schema = "instance_id long, user_id long, day int, context_timestamp long, is_trade int"
    return spark.createDataFrame(rows, schema)


def test_history(spark):
    df = _clicks(spark, [(1, 1, 20, 10, 0), (2, 1, 20, 20, 1), (3, 1, 20, 30, 0)])
    out = W.add_history(df, ("day",))
    got = {r["instance_id"]: r["history"] for r in out.collect()}
    assert got == {1: "", 2: "0", 3: "01"}


def test_history_masked_day(spark):
    df = _clicks(spark, [(1, 1, 24, 10, 1), (2, 1, 24, 20, 1)])
    out = W.add_history(df, ("day",), mask_day=24)
    assert {r["instance_id"]: r["history"] for r in out.collect()} == {1: "", 2: "0"}


def test_gaps(spark):
    df = _clicks(spark, [(1, 1, 20, 60, 0), (2, 1, 20, 180, 0), (3, 1, 20, 600, 0)])
    out = W.add_gaps(df, scopes=("day",), with_history=False).orderBy("instance_id")
    r = [tuple(x[-4:]) for x in out.collect()]
    assert r == [(None, 2.0, 9.0, 0.0), (2.0, 7.0, 7.0, 2.0), (7.0, None, 0.0, 9.0)]


def test_prior_trade(spark):
    df = spark.createDataFrame([(1, 7, 3, 10, 0), (2, 7, 3, 20, 1), (3, 7, 3, 30, 0), (4, 8, 3, 10, 0)],
                               "instance_id long, user_id long, category_1 long, context_timestamp long, is_trade int")
    out = PR.prior_trade(df, df, ["category_1", "user_id"], "show", "flag")
    got = {r["instance_id"]: (r["show"], r["flag"]) for r in out.collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 0), 4: (1, 1)}


def test_smoothed_rate(spark):
    rows = [(i, 1, 1 if i == 0 else 0) for i in range(5)] + [(9, 2, 0)]
    df = spark.createDataFrame(rows, "instance_id long, item_id long, is_trade int")
    out = RT.add_smoothed_rates(df, df, {"item_id": "item"})
    got = {r["item_id"]: r["item_ctr"] for r in out.collect()}
    assert abs(got[1] - 1 / 15) < 1e-12 and got[2] is None
    filled = out.fillna(-1, subset=["item_ctr"]).where("item_id = 2").first()["item_ctr"]
    assert filled == -1


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.5,), (100.0,)], "x double")
    got = [r["x_bin"] for r in EN.equal_width_bins(df, ["x"]).orderBy("x").collect()]
    assert got == [0, 0, 1, 9]


def test_equal_width_constant_and_null(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    got = sorted(EN.equal_width_bins(df, ["x"]).collect(), key=lambda r: (r["x"] is None, r["x"] or 0))
    assert [r["x_bin"] for r in got] == [4, 4, None]


def test_md5_bucket(spark):
    df = spark.createDataFrame([("a",), ("0",), ("中文",)], "s string")
    got = [r["h"] for r in df.select(L.md5_bucket("s").alias("h")).collect()]
    assert got == [542018, 911156, 178751]


def test_first_seen_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "t long, v string")
    out = EN.first_seen_codes(df, ["v"], ["t"], "_code").orderBy("t")
    assert [r["v_code"] for r in out.collect()] == [1, 2, 1, 3]


def test_first_seen_codes_join_path(spark, monkeypatch):
    monkeypatch.setattr(EN, "BROADCAST_BYTES", 0)  # no broadcast hint
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "t long, v string")
    out = EN.first_seen_codes(df, ["v"], ["t"], "_code").orderBy("t")
    assert [r["v_code"] for r in out.collect()] == [1, 2, 1, 3]


def test_last_of_day_flag(spark):
    df = _clicks(spark, [(1, 1, 20, 10, 0), (2, 2, 20, 10, 0), (3, 2, 20, 20, 0), (4, 2, 20, 30, 0)])
    out = W.add_ordinals(df, {"sum_day": ["user_id", "day"]})
    got = {r["instance_id"]: (r["sum_day"], r["sum_first_day"], r["sum_last_day"]) for r in out.collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 0), 3: (2, 0, 0), 4: (3, 0, 1)}


def test_negative_chunks(spark):
    rows = [(i, 1 if i < 2 else 0, i) for i in range(7)]
    df = spark.createDataFrame(rows, "instance_id long, is_trade int, context_timestamp long")
    ch = SMP.negative_chunks(df, 2, ["context_timestamp", "instance_id"])
    sizes = [SMP.chunk_training_set(ch, k).count() for k in range(3)]
    assert sizes == [4, 4, 3]


def test_group_sizes_paths_agree(spark, monkeypatch):
    rows = [(i, i % 3, i % 5, None if i == 7 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "instance_id long, user_id long, item_id long, lvl int")
    groups = {"a": ["user_id"], "b": ["user_id", "item_id"], "c": ["lvl"]}

    def sizes(**kw):
        return {r["instance_id"]: tuple(r[1:]) for r in C.add_group_sizes(df, groups, **kw).select("instance_id", *groups).collect()}
    windows, cut, joined = sizes(), sizes(max_group_rows=4), sizes(population=df)
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    assert windows == cut == joined == sizes(population=df)
    assert windows[7][2] is None  # NULL key -> NULL size
    assert windows[0] == (14, 3, 20)


def _skewed_log(spark):
    from clickfeat.plans.base import click_log
    df = click_log(spark, "/root/testdata/sf0.001")
    # one user holds a third of all rows
    return df.withColumn("user_id", F.when(F.col("instance_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))


def _equal(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_split_path_equals_windows_on_skew(spark):
    from clickfeat.operators import ordered as O
    df = _skewed_log(spark)
    for keys in (["user_id"], ["user_id", "day"], ["item_id", "user_id"]):
        _equal(O.ordered_features(df, keys, max_group_rows=None, anchor="user_id"),
               O.ordered_features(df, keys, max_group_rows=20, anchor="user_id"))


def test_split_path_null_keys_and_large_ids(spark):
    """Ids near 2^62 beside NULL users stay apart; NULL users are one group."""
    from clickfeat.operators import ordered as O
    big = 1 << 62
    rows = [(i, None if i % 14 == 0 else big + i % 4, i // 5, i % 3) for i in range(43)]
    df = spark.createDataFrame(rows, "instance_id long, user_id long, context_timestamp long, day int")
    for keys in (["user_id"], ["user_id", "day"]):
        for cut in (0, 2, 5):
            _equal(O.ordered_features(df, keys, max_group_rows=None), O.ordered_features(df, keys, max_group_rows=cut))


def test_split_path_null_times(spark):
    from clickfeat.operators import ordered as O
    rows = [(i, i % 3, None if i % 10 == 3 else 100 - i // 2) for i in range(40)]
    df = spark.createDataFrame(rows, "instance_id long, user_id long, context_timestamp long")
    for cut in (0, 3, 13):
        _equal(O.ordered_features(df, ["user_id"], max_group_rows=None), O.ordered_features(df, ["user_id"], max_group_rows=cut))
    day = df.withColumn("day", F.lit(1)).withColumn("item_id", F.lit(1))
    _equal(W.add_recent_clicks(day, 5, max_group_rows=None), W.add_recent_clicks(day, 5, max_group_rows=3))


def test_hot_null_user_is_cut(spark):
    """100 rows, 90 of them without a user: the NULL group is measured and cut."""
    from clickfeat.operators import ordered as O
    df = spark.createDataFrame([(i, i if i < 10 else None, i) for i in range(100)], "instance_id long, user_id long, context_timestamp long")
    _, chunked = O.split_anchors(df, "user_id", "context_timestamp", "instance_id", 20)
    assert chunked.count() == 90 and chunked.select("__chunk").distinct().count() > 1


def test_history_of_a_cut_user(spark):
    df = _skewed_log(spark)
    scopes = ("day", "all", "item")
    _equal(W.add_history(df, scopes, chunk_rows=None), W.add_history(df, scopes, chunk_rows=20))


def test_history_identifiers_name_the_histories(spark):
    """Equal identifiers for equal texts and for no others; cut users like uncut ones."""
    df = _skewed_log(spark)
    scopes = ("day", "all", "item", "cat1") if "category_1" in df.columns else ("day", "all", "item")
    names = [W.SCOPES[s][2] for s in scopes]
    texts = W.add_history(df, scopes, chunk_rows=None).select("instance_id", *names)
    whole = W.add_history_ids(df, scopes, chunk_rows=None)
    rows = whole.join(texts, "instance_id").collect()
    for n in names:
        pairs = {(r[n], r[f"{n}_id"]) for r in rows}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and all(int(b.split(":")[0]) == len(a) for a, b in pairs)
    _equal(whole, W.add_history_ids(df, scopes, chunk_rows=20))


def test_history_identifier_of_a_user_with_three_million_rows(spark):
    """The NULL user's history, cut at the production size, against the sum worked out in order."""
    import numpy as np
    n = 3_000_000
    df = spark.range(n).select(F.col("id").alias("instance_id"), F.lit(None).cast("long").alias("user_id"), F.col("id").alias("context_timestamp"),
                               F.lit(1).alias("day"), (F.col("id") * 2654435761 % 7 < 3).cast("int").alias("is_trade"))
    got = {r.instance_id: r.all_history_id for r in W.add_history_ids(df, ("all",)).where(F.col("instance_id").isin(0, 1, 1_999_999, 2_500_000, n - 1))
           .select("instance_id", "all_history_id").collect()}
    value = np.where(np.arange(n) * 2654435761 % 7 < 3, ord("1"), ord("0")) + 1
    sums, powers = [0, 0], [1, 1]
    for i in range(n):
        if i in got:
            assert got[i] == f"{i}:{sums[0]}:{sums[1]}"
        for k, (modulus, base) in enumerate(W._FIELDS):
            sums[k] = (sums[k] + int(value[i]) * powers[k]) % modulus
            powers[k] = powers[k] * base % modulus
    assert len(got) == 5


def test_strict_prior_trade(spark):
    rows = [(1, 7, 1, 10, 0), (2, 7, 1, 20, 1), (3, 7, 1, 20, 0), (4, 7, 1, 30, 1), (5, 8, 1, 5, 0), (6, None, 1, 9, 1), (7, 7, 2, 40, 0)]
    df = spark.createDataFrame(rows, "instance_id long, user_id long, item_id long, context_timestamp long, is_trade int")
    for cut in (None, 1):
        out = PR.prior_trade(df, df, ["item_id", "user_id"], "show", "flag", strict=True, max_group_rows=cut)
        got = {r["instance_id"]: (r["show"], r["flag"]) for r in out.collect()}
        assert got == {1: (None, 1), 2: (1, 1), 3: (2, 0), 4: (3, 0), 5: (None, 1), 6: (None, 1), 7: (None, 1)}


def test_gaps_and_ordinals_hot_scopes(spark):
    df = _skewed_log(spark)
    a = W.add_ordinals(W.add_gaps(df, with_history=False))
    b = W.add_ordinals(W.add_gaps(df, with_history=False, max_group_rows=50), max_group_rows=50)
    cols = [c for c in a.columns if "diff" in c or c.startswith("sum")]
    a, b = a.select("instance_id", *cols), b.select("instance_id", *cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_group_trades_paths_agree(spark, monkeypatch):
    rows = [(i, i % 3, i % 5, 1 if i % 7 == 0 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "instance_id long, user_id long, item_id long, is_trade int")
    groups = {"u": ["user_id"], "ui": ["user_id", "item_id"]}
    trades = {"u": "t_u", "ui": "t_ui"}
    cols = ["instance_id", "u", "ui", "t_u", "t_ui"]
    a = C.add_group_sizes(df, groups, label="is_trade", trades=trades).select(*cols)
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    b = C.add_group_sizes(df, groups, label="is_trade", trades=trades).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    r = {x["instance_id"]: tuple(x[1:]) for x in a.collect()}
    # user 0: rows 0,3,…,57 (20); trades where i % 21 == 0 -> 0, 21, 42 (3)
    assert r[0][0] == 20 and r[0][2] == 3
    # (user 1, item 1): rows 1, 16, 31, 46 -> no trade -> NULL
    assert r[1][1] == 4 and r[1][3] is None


def test_hot_path_keeps_column_order(spark):
    df = _skewed_log(spark)
    a = W.add_gaps(df, scopes=("day", "all"))
    b = W.add_gaps(df, scopes=("day", "all"), max_group_rows=50)
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_recent_clicks_merge_rank_equals_range_window(spark):
    df = _skewed_log(spark)
    cols = ["instance_id", "clicks_last_hour", "item_clicks_last_hour", "day_span_minutes"]
    a = W.add_recent_clicks(df, 3600).select(*cols)
    b = W.add_recent_clicks(df, 3600, max_group_rows=50).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_recent_counts_ties(spark):
    from clickfeat.operators import ordered as O
    rows = [(1, 7, 100), (2, 7, 100), (3, 7, 3700), (4, 7, 3701), (5, 7, 9000)]
    df = spark.createDataFrame(rows, "instance_id long, user_id long, context_timestamp long")
    got = {r["instance_id"]: r["recent"] for r in
           O.recent_counts(df, ["user_id"], 3600, max_group_rows=1).collect()}
    # [t-3600, t]: 100 -> both ties; 3700 -> 100,100,3700; 3701 -> 3700,3701 (100 < 101)
    assert got == {1: 2, 2: 2, 3: 3, 4: 2, 5: 1}


def test_distinct_counts_exact_and_approx(spark):
    from clickfeat.operators import profile as PF
    rows = [(i, i % 7, None if i % 11 == 0 else i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    exact = {r["field"]: r["n_distinct"] for r in PF.distinct_counts(df, ["a", "b", "c"]).collect()}
    assert exact == {"a": 200, "b": 7, "c": 3}
    approx = {r["field"]: r["n_distinct"] for r in PF.distinct_counts(df, ["a", "b", "c"], approx=True).collect()}
    assert approx["b"] == 7 and approx["c"] == 3 and abs(approx["a"] - 200) <= 10


def test_exclude_ids_paths(spark):
    from clickfeat.operators import rows as R
    df = spark.createDataFrame([(i,) for i in range(50)], "instance_id long")
    ids = [1, 2, 3, 49]
    a = {r[0] for r in R.exclude_ids(df, ids).collect()}
    c = {r[0] for r in R.exclude_ids(df, spark.createDataFrame([(i,) for i in ids], "x long")).collect()}
    assert a == c == set(range(50)) - set(ids)
    assert R.exclude_ids(df, []).count() == 50
