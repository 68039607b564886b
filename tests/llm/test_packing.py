import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from clickfeat.llm import packing
from clickfeat.llm.common import staged
from clickfeat.llm.packing import pack, patterns, places
from clickfeat.llm.tokens import tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_patterns_hold_every_piece_once(histogram):
    found = patterns(histogram, 64)
    held = Counter()
    for packs, content in found:
        assert packs > 0 and sum(a * b for a, b in content) <= 64
        for a, b in content:
            held[a] += packs * b
    assert held == Counter(histogram)
    total = sum(a * b for a, b in histogram.items())
    # the shortest pack is used first: at most one pack in the end is half empty or less
    assert sum(p for p, _ in found) <= max(1, 2 * total / 64 + 1)


def test_one_by_one_placing_gives_the_same_fill():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 65, 200)
        packs = []
        for x in sorted(lengths, reverse=True):
            low = min((p for p in packs if p + x <= 64), default=None)
            if low is None:
                packs.append(x)
            else:
                packs[packs.index(low)] += x
        h = Counter(int(x) for x in lengths)
        got = sorted(sum(a * b for a, b in c) for n, c in patterns(h, 64) for _ in range(n))
        assert got == sorted(packs)


def test_places_are_gapless():
    h = {5: 7, 3: 11, 2: 4, 1: 9, 16: 2}
    t = places(patterns(h, 16))
    for length, n in h.items():
        own = np.flatnonzero(t["length"] == length)
        assert t["rank"][own[0]] == 0 and (np.diff(t["rank"][own]) > 0).all() and n > t["rank"][own[-1]]


def check(rows, texts):
    """Exact round trip: every id of every text in one piece, sequences gapless."""
    ids = defaultdict(list)
    for d, t in texts:
        ids[d].append([*tokenizer(PATH).encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for d, rs in by_doc.items():
        want = Counter((a, min(2048, len(x) - a), zlib.crc32(np.array(x[a:a + 2048], "<u4").tobytes()), len(x))
                       for x in ids[d] for a in range(0, len(x), 2048))
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rs) == want
    for ps in by_seq.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= 2048
    return len(by_seq)


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack(docs, PATH).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.length for r in rows) / (2048 * n) > 0.99


def test_edges(spark):
    data = [(1, None), (2, ""), (3, "a b " * 9000), (4, "hi"), (4, "hi"), (4, "other"), (None, "no id"), (5, " "), (6, "中文 ok")]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, length int, rank int")
    check(pack(df, PATH).collect(), data)
    assert pack(df.limit(0), PATH).count() == 0


def test_one_id_of_many_copies_uses_all_buckets(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "staged", lambda df, name: seen.append(staged(df, name)) or seen[-1])
    rows = [(7, "the same text in every row")] * 20_000 + [(None, "no id")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n = check(pack(df, PATH).collect(), rows)
    per_bucket = [r["count"] for r in seen[0].where("doc_id = 7").groupBy("bucket").count().collect()]
    assert len(per_bucket) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(per_bucket) < 1.2 * 20_000 / len(per_bucket)
    assert n < 1.02 * (20_000 * 7 + 500 * 4) / 2048 + 1
