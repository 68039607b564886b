import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clickfeat.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(docs):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= 3]
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update(counts[g])
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))
        mine, whole = ({t: share(c, t) for t in kept} for c in (counts[lang, source], total))
        pairs = []
        for _, other in (g for g in groups if g[0] == lang and g[1] != source):
            theirs = {t: share(counts[lang, other], t) for t in kept}
            pairs.append((-sum((mine[t] - theirs[t])**2 // theirs[t] for t in kept), other.encode()))
        terms = [(-((mine[t] - whole[t])**2 // whole[t]), t.encode()) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(rows)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in D.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect())


def sample(n, seed, sources=7, vocabulary=400):
    rng = np.random.default_rng(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'xyz' * (i // 10 % 3)}{chr(97 + i // 40)}" for i in range(vocabulary)]
    return [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 60)), p=None)) + " Éa éA THE.the",
             rng.choice(["en", "de", None, ""]), rng.choice([*(f"s{k}" for k in range(sources)), None])) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"COLUMNS": 16, "TERMS": 40, "BUFFER": 64}, {"BUFFER": 1, "SLICE_BYTES": 100}])
def test_equals_brute_force(spark, sizes):
    """Whole blocks, and many small tiles, buffers and slices (in the product itself)."""
    docs = sample(300, 1)
    if not sizes:
        assert result(spark.createDataFrame(docs, SCHEMA)) == brute([d[1:] for d in docs])
        return
    levels = np.random.default_rng(2).integers(1, 40, (300, 9)) ** 4
    want = [[sum(int((p - q) * (p - q) // q) for p, q in zip(levels[:, i], levels[:, j])) for j in range(9)] for i in range(9)]
    old = {k: getattr(D, k) for k in sizes}
    try:
        for k, v in sizes.items():
            setattr(D, k, v)
        got = np.zeros((9, 9), np.int64)
        for i, j, value in D.joint_prices(levels):
            got[np.ix_(i, j)] += value
        assert got.tolist() == want
        batches = [b for n in (1, 7) for b in stream(levels, n)]
        total = np.zeros((2, 9, 9), np.int64)
        for b in D._products(batches):
            for lang, i, j, v in zip(*(c.to_pylist() for c in b.columns)):
                total[int(lang), i, j] += v
        assert total[1].tolist() == want and total[0].tolist() == want
    finally:
        for k, v in old.items():
            setattr(D, k, v)


def stream(levels, n):
    """Arrow batches of ``n`` rows as a task of the products reads them; language
    by the batch size, absent terms are left out."""
    import pyarrow as pa
    lang, zero = str(int(n > 1)), levels.min(axis=0)
    rows = [(lang, 0, 0, j, int(z), None) for j, z in enumerate(zero)]
    rows += [(lang, 0, 1, j, int(p), f"t{t}") for t, row in enumerate(levels) for j, p in enumerate(row) if p != zero[j]]
    schema = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("kind", pa.int32()), ("sid", pa.int64()), ("p", pa.int64()), ("term", pa.string())])
    for at in range(0, len(rows), n):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + n]), schema)], schema=schema)


ODD = [(1, None, "en", "a"), (1, "", "en", "b"), (None, "one two one", None, None), (2, "one ONE", "", ""), (3, "one two", None, "x"),
       (3, "one two", None, "x"), (4, "123 ._", "fr", "only"), (5, "x" * 200_000 + " one" * 50_000, "", "y"), (6, "é" * 3, "", "y")]


def test_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in ODD], SCHEMA + ", value int, term string, p int")
    got = result(df)
    assert got == brute([r[1:] for r in ODD])
    assert ("en", "a", "pair", "b", 0, 1) in got and not any(r[0] == "fr" for r in got)
    assert result(df.limit(0)) == []
