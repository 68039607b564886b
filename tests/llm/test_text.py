import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from clickfeat.llm.text import ALNUM, SPACED, raw, words

PATTERNS = [(SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("aB1 .é \n'", max_size=40)), max_size=8), st.integers(1, 30))
def test_words_equal_the_patterns(texts, chunk):
    for table, pattern in PATTERNS:
        buf, off = raw(pa.array(texts, pa.string()))
        s, e, h, first = words(buf, off, table, chunk)
        by_hash = {}
        for i, t in enumerate(texts):
            want = re.findall(pattern, lowered(t or ""))
            got = [bytes(buf[a:b]).decode() for a, b in zip(s[first[i]:first[i + 1]], e[first[i]:first[i + 1]])]
            assert [lowered(x) for x in got] == want
            for w, x in zip(want, h[first[i]:first[i + 1]]):
                assert by_hash.setdefault(w, x) == x
        assert len(set(by_hash.values())) == len(by_hash)


def test_a_word_longer_than_a_chunk():
    t = ["x" * 5000, "y " + "z" * 9000 + " w"]
    s, e, h, first = words(*raw(pa.array(t)), SPACED, 1000)
    assert list(e - s) == [5000, 1, 9000, 1] and list(first) == [0, 1, 4]
    assert len(np.unique(h)) == 4
