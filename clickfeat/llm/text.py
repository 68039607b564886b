"""Words of Arrow text batches, found and hashed with numpy on the UTF-8 bytes.

Both word patterns in use are defined on bytes alone (every byte of a
non-ASCII character is 0x80 or above), so a batch is read in place: one table
lookup per byte, no decoding and no Python object per word.  A word's hash is
a polynomial over its lower-cased bytes modulo 2^64, mixed at the end; the
work goes on in chunks of about a megabyte, so its memory does not depend on
the length of a text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_U = np.uint64


def _table(separators) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: ``[^\\x20\\x09-\\x0D]+``
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``
LETTERS = _table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(LOWER.astype(np.uint64) + _U(0x1234567))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets into them (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0]:o[-1]], o - o[0]


def parts(batch: pa.RecordBatch, at: int, rows: int = 2000, size: int = CHUNK):
    """Slices of the batch, of at most ``rows`` rows and about ``size`` bytes of
    the texts in column ``at``; a longer text is in a slice of its own."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(), dtype=np.int64)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(upto, upto[lo] + size, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, chunk: int = CHUNK):
    """``(start, end, hash, first)``: byte bounds and hash of every word in
    order, and for each row the index of its first word (one more at the end)."""
    n, edges, at = len(buf), offsets[1:-1], 0
    parts = [[], [], []]
    while at < n:
        to = min(n, at + chunk)
        while to < n:  # never inside a word: back to the last separator or row start, else on to the next
            tail = is_word[buf[max(at, to - 4096):to]]
            row = np.searchsorted(edges, to, "right")
            back = max(int(edges[row - 1]) if row and edges[row - 1] > at else 0,
                       to - int(tail[::-1].argmin()) if not tail.all() else 0)
            if back > at:
                to = back
                break
            to = min(n, to + chunk)
        piece = buf[at:to]
        w = is_word[piece]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        cut = edges[np.searchsorted(edges, at, "right"):np.searchsorted(edges, to, "left")] - at
        first[cut] = w[cut]
        last[cut - 1] = w[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        pw, inv = _powers(max(CHUNK, 1 << (len(piece) - 1).bit_length()))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_byte_values()[piece] * pw[:len(piece)], out=sums[1:])
        h = (sums[e] - sums[s]) * inv[s]
        parts[0].append(s + at)
        parts[1].append(e + at)
        parts[2].append(mix(h + (e - s).astype(np.uint64)))
        at = to
    s, e, h = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(parts, (np.int64, np.int64, np.uint64)))
    return s, e, h, np.searchsorted(s, offsets)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values (``len(h) - k + 1`` of them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _U(_BASE) + h[j:len(h) - k + 1 + j]
    return mix(out)
