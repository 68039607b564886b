import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from clickfeat.llm import collection, repeats as R
from clickfeat.llm.collection import construct, repeated
from clickfeat.llm.queries import op13_repeats

SCHEMA = "doc_id long, text string"


def strings(parts):
    data = np.array([x for s in parts for x in s], np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(s) for s in parts])]).astype(np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=7), st.integers(1, 6))
def test_transform_common_prefixes_and_repeats(parts, cap):
    suffixes = sorted(([x + 1000 for x in s[i:]] + [k], s[i - 1] if i else 0) for k, s in enumerate(parts) for i in range(len(s) + 1))
    lcp = [0]
    for (a, _), (b, _) in zip(suffixes, suffixes[1:]):
        n = 0
        while a[n] == b[n] >= 1000:
            n += 1
        lcp.append(min(n, cap))
    got = construct(*strings(parts), cap)
    assert got[0].tolist() == [b for _, b in suffixes] and got[1].tolist() == lcp
    seen = Counter(tuple(s[i:i + cap]) for s in parts for i in range(len(s) - cap + 1))
    want = [i + cap <= len(s) and seen[tuple(s[i:i + cap])] > 1 for s in parts for i in range(len(s))]
    assert repeated(*strings(parts), cap).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 255]), max_size=60), min_size=1, max_size=5), st.sampled_from([7, 8, 11, 16, 20]))
def test_columns_of_several_bytes(parts, length):
    seen = Counter(tuple(s[i:i + length]) for s in parts for i in range(len(s) - length + 1))
    assert repeated(*strings(parts), length).tolist() == [i + length <= len(s) and seen[tuple(s[i:i + length])] > 1 for s in parts for i in range(len(s))]


def test_a_round_takes_eight_bytes_of_every_string(monkeypatch):
    rounds, minima = [], collection._minima
    monkeypatch.setattr(collection, "_minima", lambda *a: rounds.append(1) or minima(*a))
    r = np.random.default_rng(5)
    whole = r.integers(0, 256, 295)
    got = repeated(*strings([whole, np.append(r.integers(0, 256, 3), whole[:285]), r.integers(0, 256, 290)]), 200)
    assert np.flatnonzero(got).tolist() == [*range(86), *range(295 + 3, 295 + 3 + 86)]
    assert len(rounds) == 295 // 8


def brute(docs, length=200):
    seen = Counter(b[i:i + length] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def query(spark, monkeypatch, df):
    monkeypatch.setattr("clickfeat.llm.queries.read", lambda *_: df)
    return result(op13_repeats(spark, ""))


def test_query_equals_brute_force_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert result(op13_repeats(spark, sf)) == want and sum(r[2] > 0 for r in want) > 20


def prose(rng, n):
    return " ".join("".join(rng.choice(list("aeiourstlnéß"), rng.integers(1, 9))) for _ in range(n))


def crowd():
    """One passage in many surroundings, copies, near copies, periodic text."""
    rng = np.random.default_rng(3)
    passage, foot = prose(rng, 60), prose(rng, 25)
    docs = [f"{prose(rng, 30)} {passage} {prose(rng, 30)} {foot if i % 2 else ''}" for i in range(60)]
    whole = prose(rng, 200)
    docs += [whole] * 9 + [whole[:k] + "X" + whole[k + 1:] for k in (1, 150, 700)] + ["ab" * 400, "ba" * 150, "z" * 1000, "z" * 200, "z" * 199]
    return list(enumerate(docs))


@pytest.mark.parametrize("sizes", [{}, {"HOT": 3, "BATCH_BYTES": 2000, "CHUNK": 500, "SLICE_BYTES": 3000}])
def test_hot_passages_small_batches_and_chunks(spark, monkeypatch, sizes):
    docs = crowd()
    for k, v in sizes.items():
        monkeypatch.setattr(R, k, v)
    R._constants.cache_clear()
    got = query(spark, monkeypatch, spark.createDataFrame(docs, SCHEMA).repartition(3))
    R._constants.cache_clear()
    assert got == brute(docs)


def test_other_lengths(spark):
    docs = crowd()[::4]
    for length in (20, 130):
        got = R.remove_repeats(spark.createDataFrame(docs, SCHEMA), length).selectExpr(
            "doc_id", "n_bytes", "n_bytes - length(kept)", "size(spans)", "sha2(kept, 256)")
        assert result(got) == brute(docs, length)


ODD = [(1, None), (1, ""), (None, "é" * 100), (2, "é" * 100), (2, "é" * 99 + "e"), (3, "\x00" * 250), (4, "x" * 100_000 + "y"), (4, "q")]


def test_odd_rows_and_clashing_columns(spark, monkeypatch):
    df = spark.createDataFrame([(*r, b"1", 2, 3) for r in ODD], SCHEMA + ", bytes binary, rid int, key int")
    assert query(spark, monkeypatch, df) == brute(ODD)
    assert query(spark, monkeypatch, df.limit(0)) == []


def test_staged_tables_go_once_they_are_read(spark, monkeypatch):
    import os

    from clickfeat.llm import repeats
    from clickfeat.session import ensure_checkpoint_dir
    monkeypatch.setattr(repeats, "HOT", 3)  # so that keys are cut again
    folder = ensure_checkpoint_dir(spark).removeprefix("file:") + "/clickfeat-stage"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    common = "".join(chr(97 + i * i % 23) for i in range(230))
    docs = spark.createDataFrame([(i, f"{i * 7919} " * 9 + common + f" {i * 104729}" * 9) for i in range(12)], "doc_id long, text string")
    out = repeats.remove_repeats(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"texts", "hot-keys", "repeated-windows"} and "texts" in left
    assert all(r.n_bytes - len(r.kept) >= 230 for r in out.collect())


def test_shuffle_files_go_with_the_staged_table(spark):
    import glob
    import time

    from clickfeat.llm.common import SHUFFLES_GO
    was = spark.conf.get(SHUFFLES_GO, None)
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before = files()
    out = R.remove_repeats(spark.createDataFrame(crowd()[::4], SCHEMA))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(SHUFFLES_GO, None) == was
    assert result(out.selectExpr("doc_id", "n_bytes", "n_bytes - length(kept)", "size(spans)", "sha2(kept, 256)")) == brute(crowd()[::4])
