"""Multi-valued string columns (A1-A4, A9-A10) as native expressions.

Spark 4 runs with ANSI mode on, so out-of-range indexes and bad casts
raise; ``try_element_at`` / ``try_cast`` keep the reference's tolerant
behaviour (missing level -> -1, unparsable token -> skipped).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def tokens(col, sep: str = ";") -> Column:
    """``a;b;c`` -> ``[a, b, c]`` (empty parts kept, as ``str.split``)."""
    return F.split(_c(col), sep, -1)


def category_level(col, i: int, sep: str = ";", missing: str = "-1") -> Column:
    """Level ``i`` (0-based) of a category path, ``-1`` when absent, as bigint (A1)."""
    return F.coalesce(F.try_element_at(tokens(col, sep), F.lit(i + 1)), F.lit(missing)).try_cast("bigint")


def predicted_category(col, i: int) -> Column:
    """Part before ``:`` of token ``i`` of ``cat:p,p;cat:-1;…``; -1 when absent (A2)."""
    tok = F.try_element_at(tokens(col, ";"), F.lit(i + 1))
    return F.coalesce(F.split(tok, ":", -1)[0], F.lit("-1")).try_cast("bigint")


def _parsable(col) -> Column:
    # A token without ':' raises in the reference's parser and is skipped.
    return F.filter(tokens(col, ";"), lambda t: F.size(F.split(t, ":", -1)) > 1)


def predict_categories(col) -> Column:
    """Categories of every parsable token, in order, duplicates kept (A3)."""
    return F.transform(_parsable(col), lambda t: F.split(t, ":", -1)[0])


def predict_properties(col) -> Column:
    """Properties between the first and second ``:`` of every parsable
    token; ``cat:-1`` contributes none (A3)."""
    def props(t):
        p = F.split(t, ":", -1)[1]
        return F.when(p == "-1", F.array().cast("array<string>")).otherwise(F.split(p, ",", -1))
    return F.flatten(F.transform(_parsable(col), props))


def property_count(col, sep: str = ";") -> Column:
    """Number of tokens, duplicates included (A4)."""
    return F.size(tokens(col, sep))


# md5 -> integer bucket (A9).  A 128-bit md5 does not fit a long and ``conv``
# of all 32 hex digits saturates, so reduce modulo (n-1) chunk by chunk
# (Horner's rule over four 32-bit words): exact for n - 1 < 2**31.
def md5_bucket(col, nr_bins: int = 10 ** 6) -> Column:
    m = nr_bins - 1
    if not 0 < m < 2 ** 31:
        raise ValueError("nr_bins - 1 must be in (0, 2**31)")
    h = F.md5(_c(col).cast("string"))
    r = F.lit(0).cast("bigint")
    for j in range(4):
        word = F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("bigint")
        r = (r * F.lit(2 ** 32) + word) % F.lit(m)
    return (r + 1).cast("bigint")


def hashed_token(field, value, nr_bins: int = 10 ** 6) -> Column:
    """``field:hash(value):1`` (A10): only the value is hashed."""
    return F.concat_ws(":", _c(field).cast("string"), md5_bucket(value, nr_bins).cast("string"), F.lit("1"))
