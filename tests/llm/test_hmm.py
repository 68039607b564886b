import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickfeat.llm import hmm as H
from clickfeat.llm.common import fold
from clickfeat.llm.queries import op5_hmm


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score) by the formula."""
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c, docs = Counter(), 0
    for d, t in rows:
        if not out(d):
            c.update(split(t))
            docs += 1
    n, v = sum(c.values()) + docs, len(c) + (docs > 0)
    norm = n + 0.5 * (v + 1)
    got = {}
    for d, t in rows:
        w = split(t)
        s = sum(math.log10((c[x] + 0.5) / norm) for x in w) + math.log10((docs + 0.5) / norm)
        got[d] = (out(d), len(w) + 1, sum(c[x] > 0 for x in w) + (docs > 0), n, s)
    return got


def check(rows, want):
    for r in rows:
        held, n, known, total, s = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(s, rel=1e-9) and math.isfinite(r.score) and r.score < 0


@pytest.mark.parametrize("direct", [H.DIRECT, 300])
def test_base_score_and_gain(spark, monkeypatch, direct):
    monkeypatch.setattr(H, "DIRECT", direct)  # few direct words: most counts come by the join
    monkeypatch.setattr(H, "OWN", H.OWN)
    d = "/root/testdata/sf0.01"
    rows = op5_hmm(spark, d).collect()
    check(rows, base([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]))
    for held in (True, False):
        own = [r for r in rows if r.held_out == held]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


def small_model(seed=0):
    r = np.random.default_rng(seed)
    return H.Model(r.dirichlet(np.ones(H.STATES)), r.dirichlet(np.ones(H.STATES), H.STATES), r.dirichlet(np.ones(H.CLASSES), H.STATES))


def test_forward_equals_the_plain_recursion():
    m, r = small_model(), np.random.default_rng(1)
    seqs = [r.integers(0, H.CLASSES, n) for n in (5, 1, 40, 3, 40)]
    for x, got in zip(seqs, m.forward(seqs)):
        a, total = m.start.copy(), 0.0
        for t, o in enumerate(x):
            a = (a @ m.move if t else a) * m.emit[:, o]
            total += math.log10(a.sum())
            a /= a.sum()
        assert got == pytest.approx(total, rel=1e-12)


def test_expected_counts_equal_full_enumeration():
    import itertools
    m, x = small_model(3), [4, 7, 4, 9]
    seqs = [np.array(x), np.array([7])]
    start, move, emit = np.zeros(H.STATES), np.zeros((H.STATES, H.STATES)), np.zeros((H.STATES, H.CLASSES))
    m.expected(seqs, start, move, emit)
    ws, wm, we = np.zeros_like(start), np.zeros_like(move), np.zeros_like(emit)
    for s in seqs:
        paths = []
        for p in itertools.product(range(H.STATES), repeat=len(s)):
            w = m.start[p[0]] * m.emit[p[0], s[0]]
            for a, b, o in zip(p, p[1:], s[1:]):
                w *= m.move[a, b] * m.emit[b, o]
            paths.append((w, p))
        total = sum(w for w, _ in paths)
        for w, p in paths:
            ws[p[0]] += w / total
            for a, b in zip(p, p[1:]):
                wm[a, b] += w / total
            for a, o in zip(p, s):
                we[a, o] += w / total
    for got, want in ((start, ws), (move, wm), (emit, we)):
        np.testing.assert_allclose(got, want, rtol=2e-4, atol=1e-6)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b A"), (4, " \n"), (5, "b " * 30_000), (6, "never seen"), (7, "a"), (8, "é ß")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, row int, tail string")
    check(H.score(df, fold("doc_id", 5) == 1).collect(), base(rows))
    assert H.score(df.limit(0), F.lit(False)).count() == 0
    twice = H.score(df.unionByName(df.where("doc_id = 3")), F.lit(True)).collect()  # nothing to learn from
    assert len(twice) == 9 and all(math.isfinite(r.score) and r.n_known == 0 for r in twice)
