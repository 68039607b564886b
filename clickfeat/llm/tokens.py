"""Token ids of Arrow text batches, each distinct piece encoded once.

Byte-level BPE never merges across the pieces of its pre-tokenizer, so a
batch's ids are those of its pieces in order.  The pieces are found with numpy
on code points, the distinct ones are encoded by ``tokenizers``, and the ids are
put back by position.  A text with characters outside the blocks whose classes
are settled here is encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from clickfeat.llm.text import _powers, mix, raw

SLICE = 1 << 18
SETTLED = 0x0530
JOINED = 200
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    t = np.array([kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(SETTLED)], np.uint8)
    t[[*range(9, 14), 0x20, 0x85, 0xA0]] = _SPACE
    return t


@lru_cache(maxsize=1)
def _unsettled() -> np.ndarray:
    t = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(SETTLED)])
    t[0x1C:0x20] = True
    return t


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def piece_starts(cp: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Mask of the positions where a pre-tokenizer piece begins: contractions,
    then runs of letters, of numbers and of other signs, each with one space
    before it, then the white space that is left."""
    n, kind = len(cp), _classes()[cp]
    edge = np.zeros(n + 4, bool)
    edge[row_start[row_start < n]] = edge[n] = True
    run = edge[:n + 1].copy()
    run[1:n] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    begin = run[:n].copy()
    joined = np.zeros(n, bool)
    joined[1:] = (cp[:-1] == 0x20) & ~edge[1:n]
    begin &= space | ~joined
    begin |= space & run[1:n + 1] & ~edge[1:n + 1]  # the last blank before a word: part of it, or a piece of its own
    mark = np.flatnonzero((cp == 0x27) & begin & run[1:n + 1] & ~edge[1:n + 1])
    if len(mark):
        ahead = np.concatenate([cp, np.zeros(3, cp.dtype)])
        a, b = ahead[mark + 1], ahead[mark + 2]
        pair = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))) & ~edge[mark + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        for m, length in ((mark[one], 2), (mark[pair & ~one], 3)):
            begin[m + 1] = False
            after = m[m + length < n] + length
            begin[after] |= ~joined[after] | space[after]
    return begin


def _pieces(buf: np.ndarray, offsets: np.ndarray):
    """``(start, end, hash, row, odd rows)`` of all pieces, in bytes."""
    starts, hashes, rows, odd, lo = [], [], [], [], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        at = offsets[lo]
        part = buf[at:offsets[hi]]
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        cp = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        row_start = np.searchsorted(lead, offsets[lo:hi] - at)
        strange = (cp >= SETTLED) | _unsettled()[np.minimum(cp, SETTLED - 1)]
        if strange.any():
            odd.append(np.unique(np.searchsorted(row_start, np.flatnonzero(strange), "right") - 1) + lo)
        if len(cp):
            s = np.flatnonzero(piece_starts(np.minimum(cp, SETTLED - 1), row_start))
            e = np.append(s[1:], len(cp))
            pw, inv = _powers(max(SLICE, 1 << (len(cp) - 1).bit_length()))
            sums = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(mix(cp.astype(np.uint64) + np.uint64(0x51ED)) * pw[:len(cp)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)))
            starts.append(lead[s] + at)
            rows.append(np.searchsorted(row_start, s, "right") - 1 + lo)
        lo = hi
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    s, r = cat(starts, np.int64), cat(rows, np.int64)
    return s, np.append(s[1:], len(buf)), cat(hashes, np.uint64), r, cat(odd, np.int64)


def _ids(tok, texts: list[str]):
    """Flat ids of many texts and how many each has."""
    found = [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for x in found for i in x), np.uint32, int(n.sum())), n


@lru_cache(maxsize=4)
def _byte_lengths(path: str) -> np.ndarray:
    vocabulary = tokenizer(path).get_vocab()
    t = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        t[i] = len(token)  # the byte-level alphabet has one character for each byte
    return t


def _piece_ids(tok, path: str, pieces: list[bytes]):
    """``_ids`` of pre-tokenizer pieces.  Those that begin with a word split
    off again when a line break parts them, those with a space before the word
    need none; so many go into one call, and byte lengths tell them apart."""
    blank = b" \t\n\v\f\r\xc2"
    kind = np.array([2 if p[0] in blank and (p[0] != 32 or len(p) == 1 or p[1] in blank) else int(p[0] == 32) for p in pieces])
    flat, n = [np.zeros(0, np.uint32)], np.zeros(len(pieces), np.int64)
    begin, total = np.zeros(len(pieces), np.int64), 0
    for k, sep in ((0, b"\n"), (1, b"")):
        own = np.flatnonzero(kind == k)
        size = np.array([len(pieces[i]) for i in own], np.int64)
        joined = [sep.join([pieces[i] for i in own[lo:lo + JOINED]]) + sep for lo in range(0, len(own), JOINED)]
        ids, _ = _ids(tok, [x.decode() for x in joined])
        end = np.cumsum(size + len(sep)) - len(sep)
        upto = np.concatenate([[0], np.cumsum(_byte_lengths(path)[ids])])
        a, b = np.searchsorted(upto, end - size), np.searchsorted(upto, end)
        if (upto[a] != end - size).any() or (upto[b] != end).any():
            raise AssertionError("a token crosses two pieces")
        begin[own], n[own], total = a + total, b - a, total + len(ids)
        flat.append(ids)
    rest = np.flatnonzero(kind == 2)
    ids, n[rest] = _ids(tok, [pieces[i].decode() for i in rest])
    begin[rest] = np.cumsum(n[rest]) - n[rest] + total
    return np.concatenate([*flat, ids]), begin, n


class _Pool:
    """Ids of the pieces that this worker process has met, by hash; forgotten
    all at once when there are too many.  A matter of speed only."""

    LARGEST = 1_000_000

    def __init__(self):
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.begin, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, h: np.ndarray, encode) -> np.ndarray:
        """The place of each of the distinct hashes ``h``; ``encode`` gets the
        indices of those not met before."""
        if len(self.hashes) + len(h) > self.LARGEST:
            self.__init__()
        at = np.searchsorted(self.hashes, h)
        known = np.zeros(len(h), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
        place, new = np.empty(len(h), np.int64), np.flatnonzero(~known)
        place[known] = self.order[at[known]]
        place[new] = len(self.n) + np.arange(len(new))
        if len(new):
            flat, begin, n = encode(new)
            begin = begin + len(self.flat)
            self.flat, self.begin, self.n = (np.concatenate(x) for x in ((self.flat, flat), (self.begin, begin), (self.n, n)))
            self.hashes, self.order = np.concatenate([self.hashes, h[new]]), np.concatenate([self.order, place[new]])
            by = np.argsort(self.hashes, kind="stable")
            self.hashes, self.order = self.hashes[by], self.order[by]
        return place


_POOLS: dict[str, _Pool] = {}


def token_ids(texts: pa.Array, path: str):
    """For each text (null: empty) its token ids as an unsigned 32-bit array."""
    tok = tokenizer(path)
    buf, offsets = raw(texts)
    try:
        s, e, h, row, odd = _pieces(buf, offsets)
    except UnicodeDecodeError:  # bytes that are no text: as the library's callers would read them
        clean = pa.array([bytes(buf[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
        buf, offsets = raw(clean)
        s, e, h, row, odd = _pieces(buf, offsets)
    if len(odd):
        plain = ~np.isin(row, odd)
        s, e, h, row = s[plain], e[plain], h[plain], row[plain]
    code, distinct = pd.factorize(h)
    some = np.empty(len(distinct), np.int64)
    some[code[::-1]] = np.arange(len(code))[::-1]
    whole = buf.tobytes()
    pool = _POOLS.setdefault(path, _Pool())
    place = pool.places(distinct, lambda new: _piece_ids(
        tok, path, [whole[a:b] for a, b in zip(s[some[new]].tolist(), e[some[new]].tolist())]))
    code, (flat, begin, n) = place[code], (pool.flat, pool.begin, pool.n)
    first = np.searchsorted(row, np.arange(len(offsets)))
    whole_text = {int(r): None for r in odd}
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + SLICE, "right")) - 1)
        c = code[first[lo]:first[hi]]
        k = n[c]
        upto = np.concatenate([[0], np.cumsum(k)])
        ids = flat[np.repeat(begin[c] - upto[:-1], k) + np.arange(upto[-1])]
        for r in range(lo, hi):
            if r in whole_text:
                yield _ids(tok, [whole[offsets[r]:offsets[r + 1]].decode()])[0]
            else:
                yield ids[upto[first[r] - first[lo]]:upto[first[r + 1] - first[lo]]]
        lo = hi
