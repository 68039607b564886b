import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from clickfeat.llm import structure as S
from clickfeat.llm.queries import op11_structure

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(codes):
    """Least (cost, audit) by a walk over (row, grammar state), audits and all:
    no alignment, no band."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for (state, symbol), to in step.items():
                if state in best and symbol != "s":
                    c, a = best[state]
                    best[to] = min(best.get(to, (1 << 30, "")), (c + 2, a + "I"))
        return best
    best = inserted({"0": (0, "")})
    for code in codes:
        after = {}
        for state, (c, a) in best.items():
            moves = [(state, 3, "D")]
            if code != "x":
                moves += [(to, code.isupper() + (0 if k == "K" else 2), k) for (f, symbol), to in step.items() if f == state
                          for k in (("K",) if symbol == code.lower() else ("R",) if symbol != "s" else ())]
            for to, more, k in moves:
                after[to] = min(after.get(to, (1 << 30, "")), (c + more, a + k))
        best = inserted(after)
    return min(best[s] for s in ("0", "a") if s in best)


def exhaustive(codes, most):
    """All audits up to ``most`` insertions, one by one."""
    found = []
    for n in range(most + 1):
        for at in itertools.combinations_with_replacement(range(len(codes) + 1), n):
            for way in itertools.product("DKR", repeat=len(codes)):
                audit = "".join("I" * at.count(i) + w for i, w in enumerate(way)) + "I" * at.count(len(codes))
                for target in [""] + ["u" * 0 + "ua" * m for m in range(1, 6)] + ["s" + "ua" * m for m in range(1, 6)]:
                    i = j = cost = 0
                    for e in audit:
                        c = codes[i] if e != "I" else ""
                        if e != "D" and (j >= len(target) or c == "x" or (e == "K") != (bool(c) and c.lower() == target[j]) or (e != "K" and target[j] == "s")):
                            break
                        cost += {"D": 3, "I": 2, "K": 0, "R": 2}[e] + (e in "KR" and c.isupper())
                        i, j = i + (e != "I"), j + (e != "D")
                    else:
                        if j == len(target):
                            found.append((cost, audit))
    return min(found)


@pytest.mark.parametrize("codes", ["", "s", "a", "x", "au", "sau", "uua", "aA", "Uo", "ssu", "xux", "SUA", "uas"])
def test_both_brute_forces_agree(codes):
    assert S.align(codes) == cheapest(codes) == exhaustive(codes, 2)


@settings(max_examples=400, deadline=None)
@given(st.text("suaoSUAOx", max_size=24))
def test_alignment_is_cheapest_then_least(codes):
    assert S.align(codes) == cheapest(codes)
    made = S.edits(codes, S.align(codes)[1])
    assert GRAMMAR.fullmatch("".join((role or codes[row].lower())[0] for row, role in made))


def test_long_conversation_stays_in_a_narrow_band():
    codes = "s" + "ua" * 1500 + "x" + "a" + "ua" * 1500
    assert S.align(codes)[0] == cheapest(codes)[0] == 5
    assert S.align("o" * 301)[0] == cheapest("o" * 301)[0]


def faults(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(rows):
    result = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in rows}
    rows = faults(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            core = re.findall(r"[^\x20\x09-\x0D]", text)
            own = role[:1] if role[:1] in ("u", "a", "s") else "o"
            if not core or (role, text) in seen:
                count["blank" if not core else "duplicate"] += 1
                own = "x"
            elif core[-1] not in ".!?":
                count["truncated"] += 1
                own = own.upper()
            seen.add((role, text))
            codes += own
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = cheapest(codes)
        i, state, text = 0, "0", []
        for e in audit:
            if e != "D":
                state = "s" if e == "K" and codes[i].lower() == "s" else "a" if state == "u" else "u"
                name = mine[i][1] if e == "K" else "user" if state == "u" else "assistant"
                text.append(f"{name}:{'' if e == 'I' else mine[i][2]}")
            i += e != "I"
        result[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return result


def collected(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def run_query(spark, monkeypatch, rows, schema="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, schema)
    monkeypatch.setattr("clickfeat.llm.queries.read", lambda *_: df)
    return collected(op11_structure(spark, ""))


def test_query_equals_brute_force_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert collected(op11_structure(spark, sf)) == want
    assert {c for r in want.values() for c in r[6]} == set("DIKR")


ODD = [(1, None, "user", "a."), (1, 0, None, None), (1, 0, "user", "é? "), (1, 0, "user", "é? "), (1, 9, "assistant", "x" * 100_000),
       (2, None, None, None), (None, 3, "system", "s."), (None, 3, "user", " \t\x0b\r\n"), (None, 4, "user", "b"), (None, 4, "assistant", "c!  "),
       (3, 1, "", ""), (3, 2, "assistant2", "ok."), (3, 2, "user", "ok.\x00"), (4, 5, "tool", "."), (4, 5, "Übung", "!")]


def test_odd_rows_and_clashing_columns(spark, monkeypatch):
    got = run_query(spark, monkeypatch, [(*r, 1, "x") for r in ODD], "conv_id long, turn long, role string, text string, part int, audit string")
    assert got == brute(ODD)
    assert run_query(spark, monkeypatch, []) == {}


def test_cut_conversations_equal_whole_ones(spark, monkeypatch):
    import random
    rng = random.Random(5)
    rows = [(c, rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["hi.", "no", "", "so?", str(rng.random())]))
            for c in (1, 1, 1, 1, None, None, None, 2) for _ in range(40)] + [(7, 0, "user", "same.")] * 50
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = collected(S.digests(S.repair(S.damaged(plain))))
    assert want == {k: v for k, v in brute(rows).items() if k in want} and len(want) == 4
    for size in (7, 30):
        got = S.repair(S.damaged(plain), chunk_rows=size)
        assert collected(S.digests(got)) == want
        assert got.agg({"n_parts": "max"}).first()[0] > 1
