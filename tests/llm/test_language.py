import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from clickfeat.llm import language as L
from clickfeat.llm.text import raw


def sym(t):
    return L.symbols(*raw(pa.array([t])))[0]


def brute(text: list[int], references: list[list[int]]) -> int:
    """Greedy longest phrases that occur in a reference; a phrase ends with its segment."""
    inside = {tuple(r[i:j]) for r in references for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    count = 0
    for lo in range(0, len(text), L.SEGMENT):
        part, i = text[lo:lo + L.SEGMENT], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and tuple(part[i:i + n + 1]) in inside:
                n += 1
            count, i = count + 1, i + n
    return count


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab cé", max_size=12), min_size=1, max_size=3), st.lists(st.text("ab cé9!", max_size=30), min_size=1, max_size=5), st.integers(3, 9))
def test_phrases_equal_brute_force(references, texts, segment):
    old, L.SEGMENT = L.SEGMENT, segment
    try:
        model = L.Model({"x": [sym(r) for r in references], "y": [sym("zz")]})
        got = model.phrases(*L.symbols(*raw(pa.array(texts))))
        for t, (x, y) in zip(texts, got):
            s = sym(t).tolist()
            assert x == brute(s, [sym(r).tolist() for r in references]) and y == brute(s, [sym("zz").tolist()])
    finally:
        L.SEGMENT = old


def test_edges(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "123 !?", "en"), (4, "the cat sat on the mat", "en"), (5, "le chat est sur la table", "fr"),
            (6, "le chat " * 9000, "fr"), (7, "la table", None), (8, "漢字", "zh"), (None, "the mat", "en"), (4, "the cat sat on the mat", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = {(r.doc_id, r.lang_pred): r.score for r in L.identify(df, L.learn(df)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (6, "fr"), (7, "fr"), (8, "zh"), (None, "en")} == set(out)
    assert all(0 <= s <= 1 for s in out.values())
    nothing = L.learn(df.limit(0))
    assert {r.lang_pred for r in L.identify(df, nothing).collect()} == {"und"} and L.identify(df.limit(0), nothing).count() == 0


def test_any_bytes_have_symbols():
    s, _ = L.symbols(np.arange(256, dtype=np.uint8), np.array([0, 256]))
    assert s.max() < L.BREAK


def test_the_reference_is_filled_whatever_the_texts(spark):
    """Short texts, one of them copied most often, letterless ones and one long text."""
    word = lambda i: "".join(chr(97 + i // 26 ** j % 26) for j in range(4))
    short = [" ".join(word(i * 7 + j * 131) for j in range(6)) for i in range(2000)]
    rows = [("aa", short[0])] * 3000 + [("aa", t) for t in short] + [("aa", f"{i} 12 !") for i in range(500)]
    rows += [("bb", " ".join(short)), ("bb", "kurz und gut"), ("cc", "nur dies"), ("cc", "nur dies"), ("dd", "12 34")]
    df = spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string")
    a, b = (L.learn(df.repartition(n)) for n in (1, 5))
    assert a.languages == ["aa", "bb", "cc"] and (a.table == b.table).all()
    # the length is counted with a break after each text
    assert all(2 ** bits >= L.REFERENCE for bits in a.bits[:2]) and round(2 ** a.bits[2]) == len("nur dies") + 1
    held = [t for t in short[1:]]
    aa = a.phrases(*L.symbols(*raw(pa.array(held))))[:, 0]
    assert (aa == 1).sum() > 400  # whole texts that the reference holds


def test_samples_merged_in_two_rounds_are_those_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 3)
    word = lambda i: "".join(chr(97 + i // 26 ** j % 26) for j in range(4))
    rows = [(i, " ".join(word(i * 7 + j * 131) for j in range(9)), "aa" if i % 4 else "bb") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (L.learn(df.repartition(n)) for n in (1, 13))
    assert a.languages == b.languages and (a.table == b.table).all()
