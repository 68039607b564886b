"""Personal data replaced by format-preserving Feistel pseudonyms.

Card, account and social security numbers, phone numbers, addresses of
machines and mailboxes, keys and dates are found by pattern and validated
(check digits, ranges, the calendar).  Each is permuted by a keyed Feistel
network within the set of valid values of its format (walking the cycle until
the result is valid), so the pseudonym has the same layout, passes the same check, and
is equal wherever the value is equal, in any document, while distinct values of a
format stay distinct.  The network is its own inverse under the reversed rounds.

A pattern finds where a value may begin; its admissible ends are tried (account
numbers by their country's length, cards longest first, phone numbers by their
country's usual length, then longest first), and what is no value may still hold
one.  Not read: cards in other groups than fours, 4-6-4 and 4-6-5, national phone
numbers in other groups than 3-3-4.

Only rows that could hold anything are looked at closely; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clickfeat.llm.text import parts

ROUNDS = 8
#: characters of an account number by country; other countries may have 15 to 34
IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}
#: country codes of fewer than three digits
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
#: digits after the country code, where (nearly) all numbers have as many
OWN_DIGITS = {"1": 10, "7": 10, "27": 9, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9,
              "90": 10, "91": 10, "351": 9, "353": 9, "420": 9, "421": 9}
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])


def _round(key: bytes, tweak: str, i: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}:{i}:{half}".encode(), key=key[:64], digest_size=24).digest(), "big")


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of ``range(size)``: an unbalanced Feistel network over
    ``a * b >= size``, walked until it lands inside."""
    a = max(2, int(size ** 0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        if not back:
            for i in range(ROUNDS):
                if i % 2 == 0:
                    left = (left + _round(key, tweak, i, right)) % a
                else:
                    right = (right + _round(key, tweak, i, left)) % b
        else:
            for i in reversed(range(ROUNDS)):
                if i % 2 == 0:
                    left = (left - _round(key, tweak, i, right)) % a
                else:
                    right = (right - _round(key, tweak, i, left)) % b
        x = left * b + right
        if x < size:
            return x


def _walk(x: int, size: int, key: bytes, tweak: str, valid, back: bool) -> int:
    """``permute`` again until the value is valid: a permutation of the valid ones."""
    while True:
        x = permute(x, size, key, tweak, back)
        if valid(x):
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(text: str, fresh: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(fresh)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(text, key, back):
    d = _digits(text)
    if not (13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d)):
        return None
    size = 10 ** len(d)
    ok = lambda x: (s := str(x).zfill(len(d)))[0] != "0" and len(set(s)) > 1 and luhn(s)
    if d[0] == "0":
        return None
    return _refill(text, str(_walk(int(d), size, key, f"card{len(d)}", ok, back)).zfill(len(d)))


def _iban(text, key, back):
    t = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
    if not 15 <= len(t) <= 34 or len(t) != IBAN_LENGTH.get(t[:2], len(t)) or value(t) % 97 != 1:
        return None
    body = t[4:]
    places = [i for i, c in enumerate(body) if c.isdigit()]
    if not places:
        return None
    size = 10 ** len(places)
    x = str(permute(int("".join(body[i] for i in places)), size, key, f"iban{t[:2]}{len(t)}", back)).zfill(len(places))
    body = "".join(x[places.index(i)] if c.isdigit() else c for i, c in enumerate(body))
    check = f"{98 - value(t[:2] + '00' + body) % 97:02d}"
    fresh = iter(t[:2] + check + body)
    return "".join(c if c == " " else next(fresh) for c in text)


def _ssn(text, key, back):
    ok = lambda x: (a := x // 10 ** 6) not in (0, 666) and a < 900 and x // 10 ** 4 % 100 and x % 10 ** 4
    x = int(_digits(text))
    return _refill(text, f"{_walk(x, 10 ** 9, key, 'ssn', ok, back):09d}") if ok(x) else None


def _code(digits: str) -> str:
    """The country code at the head of an international number."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3])


def _phone(text, key, back):
    a, zero, b = text.partition("(0)")  # which is not dialled from abroad and stays
    d = _digits(a + b)
    code = _code(d) if text[0] == "+" else ""  # stays
    own = d[len(code):]
    if not (8 <= len(d) <= 15 if code else len(d) == 10):
        return None
    fresh = code + f"{permute(int(own), 10 ** len(own), key, 'phone' + code, back):0{len(own)}d}"
    n = len(_digits(a))
    return _refill(a, fresh[:n]) + zero + _refill(b, fresh[n:])


def _ipv4(text, key, back):
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(p != str(int(p)) for p in text.split(".")):
        return None
    widths = [len(p) for p in text.split(".")]  # of the same written form
    low = [0 if w == 1 else 10 ** (w - 1) for w in widths]
    high = [min(255, 10 ** w - 1) for w in widths]
    size, x = 1, 0
    for p, a, b in zip(parts, low, high):
        size, x = size * (b - a + 1), x * (b - a + 1) + p - a
    x = permute(x, size, key, "ipv4" + ".".join(map(str, widths)), back)
    out = []
    for a, b in zip(reversed(low), reversed(high)):
        x, r = divmod(x, b - a + 1)
        out.append(str(r + a))
    return ".".join(reversed(out))


def _date(text, key, back):
    m = re.fullmatch(r"(\d{4})([-/.])(\d\d)\2(\d\d)", text)
    order = ("y", "m", "d")
    if not m:
        m = re.fullmatch(r"(\d\d)([-/.])(\d\d)\2(\d{4})", text)
        order = ("d", "m", "y")
    f = dict(zip(order, (m[1], m[3], m[4])))
    try:
        day = datetime.date(int(f["y"]), int(f["m"]), int(f["d"]))
    except ValueError:
        if order[0] != "d":
            return None
        order = ("m", "d", "y")
        f = dict(zip(order, (m[1], m[3], m[4])))
        try:
            day = datetime.date(int(f["y"]), int(f["m"]), int(f["d"]))
        except ValueError:
            return None
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    x = day.toordinal() - first
    if not 0 <= x <= last - first:
        return None
    # a month first is only read where the day cannot be: it stays so
    ok = (lambda v: datetime.date.fromordinal(first + v).day > 12) if order[0] == "m" else (lambda v: True)
    if not ok(x):
        return None
    day = datetime.date.fromordinal(first + _walk(x, last - first + 1, key, "date" + "".join(order) + m[2], ok, back))
    f = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
    return m[2].join(f[k] for k in order)


def _letters(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Permutes the letters and digits of a text, each within its kind."""
    kinds = {"a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}
    kind = ["0" if c in kinds["0"] else "a" if c in kinds["a"] else "A" if c in kinds["A"] else "" for c in text]
    size, x = 1, 0
    for c, k in zip(text, kind):
        if k:
            size, x = size * len(kinds[k]), x * len(kinds[k]) + kinds[k].index(c)
    if size == 1:
        return text
    x = permute(x, size, key, tweak + "".join(k or c for c, k in zip(text, kind)), back)
    out = []
    for c, k in zip(reversed(text), reversed(kind)):
        if k:
            x, r = divmod(x, len(kinds[k]))
            c = kinds[k][r]
        out.append(c)
    return "".join(reversed(out))


def _email(text, key, back):
    name, _, domain = text.rpartition("@")
    return f"{_letters(name, key, 'mail' + domain.lower(), back)}@{domain}"


def _secret(text, key, back):
    size = 16 ** len(text)
    low = text == text.lower()
    if not low and text != text.upper():
        return None
    x = f"{permute(int(text, 16), size, key, f'hex{len(text)}{low}', back):0{len(text)}x}"
    return x if low else x.upper()


NATIONAL = r"(?<![\d+])(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![-.]?\d)"
GROUPED = r"(?<!\d)(?<!\d[.-])\d{4}(?:([ -])\d{4}(?:\1\d{1,7}){2,3}|([ -])\d{6}\2\d{4,5})"
_LAYOUT = re.compile(r"\d{4}([ -])(?:\d{4}\1\d{4}\1(?:\d{1,7}|\d{4}\1\d{1,3})|\d{6}\1\d{4,5})")
#: kind, pattern, change; tried in this order at each place of a text.  A value
#: may end before its pattern does (``_ends``)
KINDS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])", _secret),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d\d\1\d\d|\d\d([-/.])\d\d\2\d{4})(?![\d]|[./-]\d)", _date),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", _ipv4),
    ("ssn", r"(?<![\d-])\d{3}-\d\d-\d{4}(?!-?\d)", _ssn),
    ("phone", r"(?<![\d+])\+[1-9]\d{0,14}(?:[ ./-]?(?:\(0\)|\(\d{2,5}\)|\d{1,14})){0,14}", _phone),
    ("phone", NATIONAL, _phone),
    ("card", r"(?<!\d)(?<!\d[.-])\d{13,19}(?![.-]?\d)", _card),
    ("card", GROUPED, _card),
]
_FIRST = re.compile(r"@[A-Za-z0-9]|\d[\d ().+/-]{6}|[0-9a-fA-F]{32}|[A-Z]{2}\d\d ?[A-Z0-9]{4}")
_SEARCH = [(kind, re.compile(pattern), change) for kind, pattern, change in KINDS]
_NATIONAL, _GROUPED = re.compile(NATIONAL), re.compile(GROUPED)


def _iban_ends(text, a, b):
    return [e for e in range(b, a + 14, -1) if text[e - 1] != " " and not (text[e:e + 1].isascii() and text[e:e + 1].isalnum())]


def _card_ends(text, a, b):
    # a card in groups of hyphens is not followed by one more, or by a fraction
    after = re.compile(r"\d|[.-]\d" if text[a + 4] == "-" else r"\d|\.\d")
    return [e for e in range(b, a + 14, -1) if text[e - 1].isdigit() and not after.match(text, e) and _LAYOUT.fullmatch(text, a, e)]


def _phone_ends(text, a, b):
    """Ends after 8 to 15 digits that do not cut another number; the country's
    usual length first."""
    digit = lambda i: text[i:i + 1].isdecimal()
    starts = [i for i in range(a + 2, b) if (digit(i) or text[i] == "(") and not digit(i - 1) and text[i - 1] != "("]
    others = [(m.start(), m.end()) for i in starts if (m := _NATIONAL.match(text, i))]
    others += [(i, e) for i in starts if (m := _GROUPED.match(text, i))
               for e in _card_ends(text, i, m.end()) if _card(text[i:e], b"any", False)]
    found = []
    for e in range(b, a + 7, -1):
        d = _digits(text[a:e].replace("(0)", "", 1))
        if (digit(e - 1) or text[e - 1] == ")") and text.count("(", a, e) == text.count(")", a, e) and not digit(e) and 8 <= len(d) <= 15:
            if not any(i < e < end for i, end in others):
                code = _code(d)
                found.append((OWN_DIGITS.get(code) != len(d) - len(code), -e))
    return [-e for _, e in sorted(found)]


def _ends(kind, text, a, b):
    """Where a value that begins at ``a`` may end, best first."""
    if kind == "iban":
        return _iban_ends(text, a, b)
    if kind == "card" and not text[a:a + 5].isdigit():
        return _card_ends(text, a, b)
    if kind == "phone" and text[a] == "+":
        return _phone_ends(text, a, b)
    return [b]


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every validated value replaced, and where they are.  An
    earlier kind goes first where two overlap."""
    if not _FIRST.search(text):
        return text, []
    new: list[tuple] = []  # sorted, without overlaps
    for kind, pattern, change in _SEARCH:
        at = 0
        while m := pattern.search(text, at):
            a, at = m.start(), m.start() + 1  # what is no value may hold one
            i = bisect.bisect(new, (a,))
            if i and new[i - 1][1] > a:
                continue
            for end in _ends(kind, text, a, m.end()):
                if i < len(new) and new[i][0] < end:
                    continue
                value = change(text[a:end], key, back)
                if value is not None:
                    new.insert(i, (a, end, value, kind))
                    at = end
                    break
    parts, at, spans = [], 0, []
    for a, b, value, kind in new:
        parts += [text[at:a], value]
        spans.append((kind, a, b - a))
        at = b
    return "".join(parts) + text[at:], spans


def _replaced(key: bytes, at: int):
    def run(batches):
        for x in (part for b in batches for part in parts(b, at)):
            texts, spans = [], []
            for t in x.column(at).to_pylist():
                new, found = (None, []) if t is None else pseudonymise(t, key)
                texts.append(new)
                spans.append([{"kind": k, "start": a, "length": n} for k, a, n in found])
            cols = list(x.columns)
            cols[at] = pa.array(texts, x.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.list_(SPAN))], names=[*x.schema.names, "__spans"])
    return run


def pseudonymised(docs: DataFrame, key: bytes, spans: str = "spans") -> DataFrame:
    """The rows with ``text`` replaced and a column of spans (code points of the
    text: kind, start, length; layouts keep their lengths).

    Null and empty texts stay; repeated rows change alike; all other columns are
    kept as they are, whatever their names (``spans`` names the new one).  The
    ``key`` (64 bytes count) is the caller's secret: with it pseudonyms can be
    undone, so there is none by default and an empty one is refused."""
    if not key:
        raise ValueError("pseudonyms need a secret key")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("__spans", T.ArrayType(T.StructType([T.StructField('kind', T.StringType()), T.StructField('start', T.LongType()), T.StructField('length', T.LongType())])))])
    return docs.mapInArrow(_replaced(key, at), schema).withColumnRenamed("__spans", spans)


def counts(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
