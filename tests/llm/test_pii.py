import datetime

import pytest
from hypothesis import given, settings, strategies as st

from clickfeat.llm import pii as P

KEY = b"key of the tests"


def pseudonymise(text, key=KEY, back=False):
    return P.pseudonymise(text, key, back)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 1001])
def test_permutation(size):
    got = [P.permute(x, size, b"k", "t") for x in range(size)]
    assert sorted(got) == list(range(size))
    assert [P.permute(y, size, b"k", "t", back=True) for y in got] == list(range(size))


TEXT = ("Mail jo.Doe7@mail3.example.com or call +1 (974) 555-3436, card 4111 1111 1111 1111 or 4485275742308327; from 129.38.82.176 on "
        "2021-02-28 and 28/02/2021, ssn 123-45-6789, DE89 3704 0044 0532 0130 00, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\".")


def test_values_change_within_their_format():
    new, spans = pseudonymise(TEXT)
    kinds = [k for k, _, _ in spans]
    assert kinds == ["email", "phone", "card", "card", "ipv4", "date", "date", "ssn", "iban", "secret"]
    assert len(new) == len(TEXT)
    for k, a, n in spans:
        old, fresh = TEXT[a:a + n], new[a:a + n]
        assert old != fresh
        assert ["0" if c.isdigit() else c for c in old if k not in ("email", "secret")] == ["0" if c.isdigit() else c for c in fresh if k not in ("email", "secret")]
        if k == "card":
            assert P.luhn(P._digits(fresh))
        if k == "ipv4":
            assert all(int(x) <= 255 for x in fresh.split("."))
        if k == "email":
            assert fresh.endswith("@mail3.example.com")
    datetime.date.fromisoformat(new[spans[5][1]:spans[5][1] + 10])
    assert pseudonymise(new, back=True)[0] == TEXT
    assert [s[0] for s in pseudonymise(new)[1]] == kinds


def test_neighbouring_numbers_are_told_apart():
    good, bad = "4845168114407329", "7536784127813051"
    assert P.luhn(good) and not P.luhn(bad)
    new = pseudonymise(good)[0]
    for t in (f"{bad} {good}", f"{good} {bad}", f"{good} 484", f"{bad}\n{good} {good}"):
        assert pseudonymise(t)[0] == t.replace(good, new), t


@pytest.mark.parametrize("value, kind, others", [
    ("ES91 2100 0418 4502 0005 1332", "iban", ["{} BIC", "AB12 {} 1234 X", "{}"]),
    ("BE68 5390 0754 7034", "iban", ["{} EUR", "{} 1234"]),
    ("NO9386011117947", "iban", ["{} EUR", "{} {}"]),
    ("4111 1111 1111 1111", "card", ["{} 12/26", "{} 123", "1234 {} 5", "{} 974 555", "{}"]),
    ("4111-1111-1111-1111", "card", ["{} 12-26", "{}"]),
    ("3782 822463 10005", "card", ["{} 12/26"]),
    ("3056 930902 5904", "card", ["{}"]),
    ("6304 0000 0000 0000 000", "card", ["{}"]),
    ("+33 1 23 45 67 89", "phone", ["{}", "{} 12 rue", "{},"]),
    ("+44 (0)20 7946 0958", "phone", ["{}", "({})"]),
    ("+44 20 794 609 5800", "phone", ["{}"]),
    ("+49 30 123456", "phone", ["{}", "{} x"]),
    ("+4930123456", "phone", ["{}"]),
    ("+35312345", "phone", ["{}"]),
])
def test_a_value_is_found_whatever_follows(value, kind, others):
    new, spans = pseudonymise(value)
    assert spans == [(kind, 0, len(value))] and new != value
    for t in others:
        assert pseudonymise(t.format(value, value))[0] == t.format(new, new), t
        assert pseudonymise(t.format(new, new), back=True)[0] == t.format(value, value), t


def test_two_values_in_a_row():
    values = ["4111 1111 1111 1111", "5500 0000 0000 0004", "974 555 3436", "+49 30 1234567", "ES91 2100 0418 4502 0005 1332"]
    for a in values:
        for b in values:
            assert pseudonymise(f"{a} {b}")[0] == f"{pseudonymise(a)[0]} {pseudonymise(b)[0]}", (a, b)
    a, b = "+44 20 7946 0958", "+442079460958"
    assert P._digits(pseudonymise(a)[0]) == P._digits(pseudonymise(b)[0])
    for t in ("+1234567", "+1234567890123456", "ES91 2100 0418 4502 0005 1333 BIC", "4111 1111 1111 1112 12/26"):
        assert pseudonymise(t) == (t, []), t


def test_same_value_same_pseudonym_other_key_another():
    a, b = pseudonymise("x 4485275742308327 y")[0], pseudonymise("4485275742308327")[0]
    assert a[2:18] == b and pseudonymise("4485275742308327", b"other")[0] != b


def test_what_is_no_valid_value_stays():
    for t in ["9807915762804490"[:-1] + "1", "300.1.2.3", "1.2.3", "2021-02-30", "31/31/2021", "000-12-3456", "1234567890123456789012", "v1.2.3.4.5",
              "0000000000000000", "12345", "abc@def", "DE00 3704 0044 0532 0130 00", "01.002.3.4"]:
        assert pseudonymise(t) == (t, []), t


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789 .-/@+()aAé", max_size=80))
def test_round_trip(t):
    new, spans = pseudonymise(t)
    assert len(new) == len(t)
    assert pseudonymise(new, back=True)[0] == t or any(k in ("card", "phone") for k, _, _ in spans)


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, TEXT, "c"), (3, TEXT, "c"), (None, "é 129.38.82.176", "d"), (4, "w 1 " * 50_000 + "129.38.82.176", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = P.pseudonymised(df, KEY, spans="found")
    got = out.collect()
    assert out.columns == ["doc_id", "text", "spans", "found"]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted([(d, t and pseudonymise(t)[0], s) for d, t, s in rows], key=key)
    assert P.pseudonymised(df.limit(0), KEY).count() == 0


def test_no_key_no_pseudonyms(spark):
    with pytest.raises(ValueError):
        P.pseudonymised(spark.range(1).selectExpr("id doc_id", "'x' text"), b"")


def test_documents_keep_everything_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    old = dict(docs.collect())
    for r in P.pseudonymised(docs, KEY).collect():
        at = 0
        for s in r.spans:
            assert r.text[at:s.start] == old[r.doc_id][at:s.start] and r.text[s.start:s.start + s.length] != old[r.doc_id][s.start:s.start + s.length]
            at = s.start + s.length
        assert r.text[at:] == old[r.doc_id][at:]
