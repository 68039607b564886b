"""Repair of conversation structure by Wagner-Fischer alignment to the strings
of a grammar.

The role initials of a well-formed conversation are empty, ``(ua)+`` or
``s(ua)+``: one target string for every feasible length.  A conversation is
written as one code letter a row and aligned to the targets by dynamic
programming.  Targets that end alike are suffixes of one another, so one table
(rows left x symbols left) holds the alignment to every length; it is filled
only inside Ukkonen's band, the cells that a repair no dearer than the bound
can visit.  The bound starts small, doubles, and never exceeds the incumbent
(keep or rename every row, add one at the end).  Cheapest lengths are traced
back, always by the least letter, and the least audit wins.

Edits: ``K`` keep 0, ``R`` rename to user or assistant 2, ``D`` delete 3 (a must
for blank and repeated rows), ``I`` insert an empty user or assistant row 2;
a truncated row that stays adds 1.

On Spark: one exchange by conversation; equal code strings are aligned once a
batch.  A conversation of more than ``CHUNK_ROWS`` rows (the null one included)
is cut into chunks by a range partitioning of its rows.  Every chunk is aligned
between all pairs of grammar states; a summary of 16 costs a chunk is joined up
along the conversation, and only the chosen alignment of a chunk is traced.
No edit before a chunk's first row is dealt to the chunk before, so audits of
equal cost are never prefixes of each other and comparing chunk by chunk is
comparing whole audits.

Nulls in role or text are one space (such a text is blank); null turns come
first, ties in turn go by role and text; a null conversation is a conversation;
extra columns are ignored; no rows give no conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickfeat.llm.common import staged

CHUNK_ROWS = 2048
_FAR = 1 << 29
STATES = "0sua"  # nothing yet, after s, after u, after a
_NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
EDIT = "struct<row:int,role:string>"


class _Table:
    """Costs of aligning ``codes[i:]`` to the last ``r`` symbols of an alternating
    string that ends in ``end``, for ``r`` within ``w`` of the rows that may stay."""

    def __init__(self, codes: str, end: str, tail: bool, w: int):
        n = len(codes)
        self.codes, self.end, self.w = codes, end, w
        self.live = np.zeros(n + 1, np.int64)
        self.live[:n] = np.cumsum([c != "x" for c in reversed(codes)])[::-1]
        self.g = np.full((n + 1, 2 * w + 1), _FAR, np.int64)
        t = np.arange(2 * w + 1)
        r = t - w
        self.g[n] = np.where((r == 0) | ((r > 0) & tail), 2 * r, _FAR)
        for i in range(n - 1, -1, -1):
            c, r, below = codes[i], self.live[i] - w + t, self.g[i + 1]
            if c == "x":
                row = below + 3
            else:
                row = np.full(2 * w + 1, _FAR, np.int64)
                row[:-1] = below[1:] + 3
                is_end = (r % 2 == 1) == (c.lower() == end)
                keep = np.where(is_end, 0, 2) if c.lower() in "ua" else 2
                np.minimum(row, below + keep + c.isupper(), out=row)
            row[r < 0] = _FAR
            self.g[i] = np.minimum(np.minimum.accumulate(row - 2 * t) + 2 * t, _FAR)

    def cost(self, i: int, r: int) -> int:
        t = r - self.live[i] + self.w
        return int(self.g[i, t]) if 0 <= t <= 2 * self.w and r >= 0 else _FAR

    def symbol(self, r: int) -> str:
        return self.end if r % 2 else "ua"[self.end == "u"]

    def lengths(self, i: int, first: str):
        """Lengths within the band whose string starts with ``first``."""
        low = max(1, int(self.live[i]) - self.w)
        return [r for r in range(low, int(self.live[i]) + self.w + 1) if self.symbol(r) == first]

    def trace(self, i: int, r: int) -> str:
        """The ASCII-least cheapest audit."""
        out = []
        while i < len(self.codes) or r:
            here = self.cost(i, r)
            c = self.codes[i] if i < len(self.codes) else None
            if c is not None and here == 3 + self.cost(i + 1, r):
                out.append("D")
                i += 1
            elif r and here == 2 + self.cost(i, r - 1):
                out.append("I")
                r -= 1
            else:
                out.append("K" if c.lower() == self.symbol(r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def incumbent(codes: str) -> int:
    """Cost of deleting what must go and renaming the rest in place."""
    stay = [c for c in codes if c != "x"]
    kept = sum(c.isupper() + (0 if c.lower() == "ua"[j % 2] else 2) for j, c in enumerate(stay))
    return 3 * (len(codes) - len(stay)) + kept + 2 * (len(stay) % 2)


@lru_cache(maxsize=1 << 14)
def align(codes: str, start: str = "0", end: str | None = None) -> tuple[int, str] | None:
    """``(cost, audit)`` of the cheapest, then ASCII-least, repair of ``codes`` from
    grammar state ``start``: to state ``end`` without insertions behind the last
    row, or (``None``) to a full stop.  ``None`` where there is none."""
    found = []
    if start == "0" and end in (None, "0"):
        found.append((3 * len(codes), "D" * len(codes)))
    if end == "s":
        return _one_kept(codes) if start == "0" else (3 * len(codes), "D" * len(codes)) if start == "s" else None
    if end != "0":
        last = end or "a"
        if start == last:
            found.append((3 * len(codes), "D" * len(codes)))
        must = 3 * codes.count("x") + sum(c.isupper() for c in codes)
        most = min([incumbent(codes)] if start == "0" and end is None else [_FAR], default=_FAR)
        spare, whole = 8, 2 * len(codes) + 8
        while True:
            spare = min(spare, max(most - must, 0), whole)
            got = _lengths(codes, start, last, end is None, spare // 2 + 1)
            best = min((c for c, _ in got), default=_FAR)
            if best <= must + spare or spare >= min(whole, most - must):
                found += [(c, a()) for c, a in got if c == best and best < _FAR]
                break
            spare *= 2
    return min(found, default=None)


def _one_kept(codes: str):
    """To the single symbol ``s``: the cheapest row that can be kept as it."""
    at = [(3 * (len(codes) - 1) + c.isupper(), "D" * i + "K" + "D" * (len(codes) - 1 - i)) for i, c in enumerate(codes) if c.lower() == "s"]
    return min(at, default=None)


def _lengths(codes: str, start: str, last: str, tail: bool, w: int):
    """``(cost, audit on demand)`` of every feasible length inside the band."""
    table = _Table(codes, last, tail, w)
    out = [(table.cost(0, r), lambda r=r: table.trace(0, r)) for r in table.lengths(0, _NEXT[start])]
    if start == "0":  # behind a kept system row
        for i, c in enumerate(codes):
            if c.lower() == "s":
                out += [(3 * i + c.isupper() + table.cost(i + 1, r), lambda i=i, r=r: "D" * i + "K" + table.trace(i + 1, r))
                        for r in table.lengths(i + 1, "u")]
    return out


def edits(codes: str, audit: str, start: str = "0"):
    """The repaired rows in order: ``row`` (-1: inserted) and the new role
    (``None``: its own)."""
    out, i, state = [], 0, start
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        state = "s" if letter == "K" and codes[i].lower() == "s" else _NEXT[state]
        out.append((-1 if letter == "I" else i, None if letter == "K" else {"u": "user", "a": "assistant"}[state]))
        i += letter != "I"
    return out


def _whole(codes: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """``start`` 0 and ``end`` null: whole conversations; else the chosen way through a chunk."""
    rows = []
    for c, s, e in zip(codes, start, end):
        cost, audit = align(c, s, e if isinstance(e, str) else None)
        rows.append((cost, audit, [{"row": r, "role": x} for r, x in edits(c, audit, s)]))
    return pd.DataFrame(rows, columns=["cost", "audit", "edits"])


def _ways(codes: pd.Series, last: pd.Series) -> pd.Series:
    """For every pair of states ``[cost, place of the audit among those from the
    same state]``, flat; -1 where there is no way."""
    out = []
    for c, is_last in zip(codes, last):
        flat = []
        for s in STATES:
            ways = [align(c, s, e) for e in STATES] if not is_last else [align(c, s) if e == "a" else None for e in STATES]
            order = sorted(w[1] for w in ways if w)
            flat += [x for w in ways for x in ((w[0], order.index(w[1])) if w else (-1, -1))]
        out.append(flat)
    return pd.Series(out)


def _joined_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states that the cheapest, then least, repair of one cut conversation
    passes between its chunks (16 costs a chunk, whatever the chunk holds)."""
    pdf = pdf.sort_values("__chunk")
    ways = np.stack([np.asarray(w, np.int64).reshape(4, 4, 2) for w in pdf["ways"]])
    cost = np.where(ways[..., 0] < 0, 1 << 60, ways[..., 0])
    after = np.zeros((len(ways) + 1, 4), np.int64)
    for k in range(len(ways) - 1, -1, -1):
        after[k] = np.minimum((cost[k] + after[k + 1][None]).min(axis=1), 1 << 60)
    state, starts, ends = 0, [], []
    for k in range(len(ways)):
        total = cost[k, state] + after[k + 1]
        exit_ = min((x for x in range(4) if total[x] == total.min()), key=lambda x: ways[k, state, x, 1])
        starts.append(STATES[state])
        ends.append(STATES[exit_])
        state = exit_
    return pd.DataFrame({"conv_id": pdf["conv_id"], "__chunk": pdf["__chunk"], "part": range(len(ways)), "n_parts": len(ways),
                         "start": starts, "end": [*ends[:-1], None]})


_INK = r"[^\x20\x09-\x0D]"


def _coded(rows: DataFrame, repeated: Column) -> DataFrame:
    """``initial``, the first ``fault`` of each row and its code letter."""
    initial = F.substring("role", 1, 1)
    core = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = (F.when(~F.regexp_like("text", F.lit(_INK)), "blank").when(repeated, "duplicate")
             .when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated"))
    own = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(own)).otherwise(own)
    return rows.select("*", initial.alias("initial"), fault.alias("fault")).withColumn("code", code)


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each conversation or chunk: counts, codes and its rows in order."""
    row = F.struct("turn", "role", "text", "__copy", "code", "initial")
    of = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"), of("blank"), of("duplicate"), of("truncated"))
    pairs = F.expr("filter(sequence(1, greatest(size(rows) - 1, 1)), i -> size(rows) > 1 AND "
                   "concat(rows[i - 1].initial, rows[i].initial) NOT IN ('su', 'ua', 'au'))")
    return g.select("*", F.array_join("rows.code", "").alias("codes"), F.size(pairs).cast("long").alias("illegal"))


def _turns() -> Column:
    return F.expr("transform(done.edits, e -> struct(coalesce(e.role, rows[e.row].role) AS role, if(e.row < 0, '', rows[e.row].text) AS text))")


def _align_udf():
    return F.pandas_udf(_whole, f"cost long, audit string, edits array<{EDIT}>")


def _joined(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join in which nulls are equal, with the keys of ``a``."""
    b = b.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in keys]
    return a.join(b, on, how).drop(*[f"__b_{k}" for k in keys])


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ["conv_id", "part", "n_parts", *NUMBERS, "audit", "turns"]


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows (conv_id, turn, role, text)`` -> the repair of each conversation:
    ``conv_id, part, n_parts, gaps, blank, duplicate, truncated, illegal, cost,
    audit, turns (array of role, text)``.

    A conversation of up to ``chunk_rows`` rows is one row, part 0 of 1.  A larger
    one comes in parts, in order from 0: audit and turns are those of the part,
    the numbers, those of the whole conversation, stand in part 0 and are null
    in the others."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", blank("role"), blank("text"))
    large = staged(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows), "large-conversations")
    total = large.agg(F.sum("n")).first()[0]
    large = large.select("conv_id")
    plain = rows if not total else _joined(rows, large, "conv_id", how="left_anti")
    plain = plain.withColumn("__copy", F.lit(0).cast("long")).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    coded = _coded(plain.withColumn("__nth", nth), F.col("__nth") > 1)
    seen = F.array_distinct(F.filter("rows.turn", lambda t: t.isNotNull()))
    gaps = F.when(F.size(seen) > 0, F.array_max(seen) - F.array_min(seen) + 1 - F.size(seen)).otherwise(0)
    out = (_gathered(coded, "conv_id").withColumn("done", _align_udf()("codes", F.lit("0"), F.lit(None).cast("string")))
           .select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("n_parts"), gaps.cast("long").alias("gaps"),
                   *NUMBERS[1:5], "done.cost", "done.audit", _turns().alias("turns")))
    if not total:
        return out
    return out.unionByName(_cut(_joined(rows, large, "conv_id", how="left_semi"), int(total // chunk_rows) + 1))


def _cut(rows: DataFrame, chunks: int) -> DataFrame:
    """The conversations that are too long for one task, chunk by chunk."""
    # equal rows differ in __copy, so that a chunk is bounded whatever repeats
    rows = staged(rows.withColumn("__copy", F.monotonically_increasing_id())
                  .repartitionByRange(chunks, "conv_id", "turn", "role", "text", "__copy")
                  .withColumn("__chunk", F.spark_partition_id()), "conversation-chunks")
    keys = ("conv_id", "role", "text")
    first = rows.groupBy(*keys).agg(F.min(F.struct("turn", "__copy")).alias("first"))
    both = _joined(rows, first, *keys)
    parts = staged(_gathered(_coded(both, F.struct("turn", "__copy") != F.col("first")), "conv_id", "__chunk"), "conversation-parts")
    along = Window.partitionBy("conv_id").orderBy("__chunk")
    small = parts.select("conv_id", "__chunk", *NUMBERS[1:5], F.col("rows")[0]["initial"].alias("head"),
                         F.element_at("rows", -1)["initial"].alias("tail"), "codes")
    crossing = F.concat(F.lag("tail").over(along), F.col("head"))
    small = small.select("*", F.lead("__chunk").over(along).isNull().alias("last"),
                         F.when(~crossing.isin("su", "ua", "au"), 1).otherwise(0).alias("crossing"))
    small = staged(small.withColumn("ways", F.pandas_udf(_ways, "array<long>")("codes", "last")).drop("codes"), "conversation-ways")
    kind = dict(rows.dtypes)["conv_id"]
    via = small.select("conv_id", "__chunk", "ways").groupBy("conv_id").applyInPandas(
        _joined_up, f"conv_id {kind}, __chunk int, part long, n_parts long, start string, end string")
    done = _joined(parts, via, "conv_id", "__chunk").select(
        "conv_id", "part", "n_parts", "rows", _align_udf()("codes", "start", "end").alias("done"))
    done = staged(done.select("conv_id", "part", "n_parts", "done.cost", "done.audit", _turns().alias("turns")), "conversation-repairs")
    numbers = small.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in NUMBERS[1:4]],
                                           F.sum(F.col("illegal") + F.col("crossing")).alias("illegal"))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    for other in (rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps")),
                  done.groupBy("conv_id").agg(F.sum("cost").alias("cost"))):
        numbers = _joined(numbers, other, "conv_id")
    first = numbers.withColumn("part", F.lit(0).cast("long"))
    return _joined(done.drop("cost"), first, "conv_id", "part", how="left").select(*RESULT)


def _hashed(batches):
    """Digest of each conversation's parts, which arrive in order: one running hash."""
    state = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["part"] == 0:
                state = [row, [], hashlib.sha256(), False]
            first, audits, digest, begun = state
            audits.append(row["audit"])
            if row["any"]:
                digest.update((b"\n" if begun else b"") + row["repaired"].encode())
                state[3] = True
            if row["part"] == row["n_parts"] - 1:
                out.append({**{c: first[c] for c in ("conv_id", *NUMBERS)}, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [batch.schema.field(c) for c in ("conv_id", *NUMBERS)] + [("audit", pa.string()), ("repaired_sha256", pa.string())]))


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: the numbers, the whole audit and ``repaired_sha256``
    (``role:text`` of the turns, joined by newlines).  The parts of a cut
    conversation stream through one hash in order; no task holds them."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = repaired.where("n_parts = 1").select("conv_id", *NUMBERS, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    cut = repaired.where("n_parts > 1").select("conv_id", "part", "n_parts", *NUMBERS, "audit", (F.size("turns") > 0).alias("any"), text.alias("repaired"))
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(cut.mapInArrow(_hashed, whole.schema))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults planted by ``crc32("conv_id:turn") % 20``: 0 drops a row,
    1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    nonnull = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(nonnull("conv_id"), F.lit(":"), nonnull("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(nonnull("text"), ".!?", "")).otherwise(nonnull("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(nonnull("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))))
    return rows.drop("col")
