"""Language identification by cross-parsing entropy (Ziv & Merhav, 1993).

A suffix automaton holds each language's reference text.  A text is parsed
greedily against it into the longest phrases that occur in the reference;
``phrases * log2(reference length) / symbols`` estimates the bits a symbol of
the text costs a coder that knows the language, and the cheapest language wins.

Automata become one dense transition table, so a batch is parsed in lock step:
every step moves all segments through all languages by one table lookup.  Texts
are parsed whole, in segments of ``SEGMENT`` symbols; a phrase ends with its
segment.  The reference is a bounded sample: ``REFERENCE`` symbols a language as
far as its texts go, ``TOTAL`` in all (a symbol is a byte, or a run of ASCII other
than letters).  Texts are cut into pieces of ``PIECE`` bytes; distinct pieces with a
letter enter in order of a hash of their content, all first pieces before any
second one, so that no long or repeated text fills it alone.  Of a text, the first
``REFERENCE`` characters can enter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickfeat.llm.text import raw

REFERENCE, TOTAL, PIECE = 16_384, 131_072, 1024
SEGMENT = 2048
FAN = 1024  # samples that a task merges: about the root of a large table's partitions
GAP, BREAK, SYMBOLS = 26, 91, 92  # any run of other ASCII; between reference texts
NEW = 1 << 30  # set in a transition that begins a phrase


def _symbols_of_bytes() -> np.ndarray:
    t = np.full(256, GAP, np.uint8)
    t[65:91] = t[97:123] = np.arange(26)
    t[0x80:0xC0] = 27 + np.arange(64)
    t[0xC0:] = 27 + np.arange(64)
    return t


_SYMBOL = _symbols_of_bytes()


def symbols(buf: np.ndarray, offsets: np.ndarray):
    """Symbols of all rows, and each row's bounds among them."""
    s = _SYMBOL[buf]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
    keep[offsets[:-1][offsets[:-1] < len(s)]] = True
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the
    empty word."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text.tolist():
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] != length[p] + 1:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return go


class Model:
    """Languages in order, the bits of one phrase in each, one table for all:
    cell ``state + symbol`` holds the next state (times ``SYMBOLS``) and ``NEW``."""

    def __init__(self, references: dict[str, list[np.ndarray]]):
        self.languages = sorted(references)
        tables, self.root, self.bits, at = [], [], [], 0
        for language in self.languages:
            text = np.concatenate([np.append(x, np.uint8(BREAK)) for x in references[language]])
            go = automaton(text)
            t = np.empty((len(go), SYMBOLS), np.int32)
            t[:] = at | NEW
            for c, to in go[0].items():
                t[:, c] = (at + to * SYMBOLS) | NEW
            for state, moves in enumerate(go):
                for c, to in moves.items() if state else ():
                    t[state, c] = at + to * SYMBOLS
            t[:, BREAK] = at | NEW  # no text has it
            tables.append(t.reshape(-1))
            self.root.append(at)
            self.bits.append(np.log2(max(2, len(text))))
            at += t.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of every row (first axis) in every language."""
        n = np.diff(bounds)
        pieces = -(-n // SEGMENT)
        row = np.repeat(np.arange(len(n)), pieces)
        begin = bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        size = np.minimum(SEGMENT, bounds[1:][row] - begin)
        by = np.argsort(-size, kind="stable")
        row, begin, size = row[by], begin[by], size[by]
        active = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # segments longer than the step
        padded = np.append(s, np.zeros(SEGMENT, np.uint8))
        grid = np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)[begin].T.copy() if len(row) else np.zeros((0, 0), np.uint8)
        state = np.repeat(np.array(self.root, np.int32)[:, None], len(row), 1)
        count = np.zeros((len(self.languages), len(row)), np.int32)
        for step in range(int(size.max(initial=0))):
            m = active[step]
            to = self.table.take(state[:, :m] + grid[step, :m])
            count[:, :m] += to >> 30
            state[:, :m] = to & (NEW - 1)
        out = np.zeros((len(n), len(self.languages)), np.int64)
        np.add.at(out, row, count.T)
        return out


def _has_letter(buf, offsets):
    ascii_ = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))])[offsets]
    high = np.concatenate([[0], np.cumsum(buf >= 0x80)])[offsets]
    found = np.diff(ascii_) > 0
    for i in np.flatnonzero(~found & (np.diff(high) > 0)):
        found[i] = any(c.isalpha() for c in bytes(buf[offsets[i]:offsets[i + 1]]).decode("utf-8", "replace"))
    return found


class _Sample:
    """The first distinct pieces of every language by (number in its text, hash)
    up to its share of symbols.  Those of all rows are among those of any parts."""

    def __init__(self):
        self.pieces: dict[str, set] = {}
        self.last: dict[str, tuple] = {}  # of a full language

    def add(self, language: str, number: int, piece: bytes) -> bool:
        """False where neither this piece nor a later one of its text can enter."""
        last = self.last.get(language)
        if last is not None and number > last[0]:
            return False
        key = (number, hashlib.blake2b(piece, digest_size=8).digest(), piece)
        if last is None or key < last:
            self.pieces.setdefault(language, set()).add(key)
        return True

    def cut(self) -> dict[str, list[np.ndarray]]:
        """Drops what is beyond the share; the references."""
        out = {}
        for language in sorted(self.pieces):
            kept, known, texts, size = [], set(), [], 0
            for key in sorted(self.pieces[language]):
                b = np.frombuffer(key[2], np.uint8)
                bounds = np.array([0, len(b)])
                if key[2] in known or not _has_letter(b, bounds)[0]:
                    continue
                known.add(key[2])
                texts.append(symbols(b, bounds)[0])
                kept.append(key)
                size += len(texts[-1])
                if size >= REFERENCE:
                    self.last[language] = key
                    break
            self.pieces[language] = set(kept)
            if texts:
                out[language] = texts
        self.pieces = {k: v for k, v in self.pieces.items() if v}
        share = max(1, min(REFERENCE, TOTAL // max(1, len(out))))
        for language, texts in out.items():
            size = np.cumsum([len(x) for x in texts])
            n = int(np.searchsorted(size, share)) + 1
            if n <= len(texts):
                key = sorted(self.pieces[language])[n - 1]
                self.pieces[language] = {k for k in self.pieces[language] if k <= key}
                self.last[language] = key
                out[language] = [*texts[:n - 1], texts[n - 1][:share - (int(size[n - 2]) if n > 1 else 0)]]
        return out


def _sampled(batches):
    """Rows ``(lang, number, text)``: whole texts (number null) or their pieces."""
    sample = _Sample()
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            for language, number, text in zip(*(c.to_pylist() for c in b.slice(lo, 2000).columns)):
                if number is not None:
                    sample.add(language, number, text)
                    continue
                for i in range(0, len(text), PIECE):
                    if not sample.add(language, i // PIECE, text[i:i + PIECE]):
                        break
            sample.cut()
    rows = [(language, key[0], key[2]) for language, keys in sample.pieces.items() for key in keys]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))],
                                     ["lang", "number", "text"])


def learn(docs: DataFrame) -> Model:
    """The model of ``docs (doc_id, text, lang)``; rows without text or lang and
    pieces without a letter are left out."""
    texts = docs.where("text is not null and lang is not null").select(
        "lang", F.lit(None).cast("int").alias("number"), F.encode(F.substring("text", 1, REFERENCE), "utf-8").alias("text"))
    names = "lang string, number int, text binary"
    # samples of samples: first by groups of partitions, so that a language of all
    # partitions sends one task the samples of FAN groups and no more
    group = F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("part")
    rows = texts.mapInArrow(_sampled, names).select("*", group).repartition("lang", "part").drop("part").mapInArrow(_sampled, names)
    rows = rows.repartition("lang").mapInArrow(_sampled, names).toArrow()  # at most the references
    sample = _Sample()
    for row in zip(*(rows[c].to_pylist() for c in ("lang", "number", "text"))):
        sample.add(*row)
    return Model(sample.cut())


def _predicted(model):
    def run(batches):
        m: Model = model.value
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                buf, offsets = raw(part.column("text"))
                s, bounds = symbols(buf, offsets)
                ok = _has_letter(buf, offsets)
                best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                if m.languages:
                    n = np.maximum(np.diff(bounds), 1)
                    cost = m.phrases(s, bounds) * np.array(m.bits) / n[:, None]
                    best = cost.argmin(axis=1)
                    more = (cost - cost.min(axis=1, keepdims=True)) * np.minimum(n, 64)[:, None]
                    score = np.where(ok, 1 / np.exp2(-np.minimum(more, 500)).sum(axis=1), 0.0)
                names = np.array([*m.languages, "und"], object)
                pred = names[np.where(ok & bool(m.languages), best, len(m.languages))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                                 ["doc_id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs (doc_id, text, ...)`` -> ``doc_id, lang_pred, score`` for every row.

    ``und`` with score 0 for null texts, texts without a letter and a model
    without languages; equal costs go to the first language by name; repeated
    rows get the same answer; other columns (``lang`` too) are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double")
