"""Column-wise construction of a collection's Burrows-Wheeler transform and its
common prefixes (Bauer, Cox & Rosone, "Lightweight algorithms for constructing
and inverting the BWT of string collections", 2013; Cox, Garofalo, Rosone &
Sciortino for the common prefixes).

Strings are inserted from their last symbol to their first, one symbol of
every string a round.  The transform and the common prefixes are two sequences
that each round reads once from front to back and writes anew with the round's
symbols merged in; besides them a round holds one place for each string.
Common prefixes are only told up to ``cap``.

The transform is held by its symbols: the places of each symbol, in order, which
is where a round's suffixes go.  Symbols may be many, so a column may be several
bytes wide (``columns``): a string then enters once for every byte that a column
can begin with, and as many times fewer rounds read and write the sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDEST = 8  # bytes of a column
_PLACE = np.int64((1 << 32) - 1)


def _minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``min(values[low:high])`` for non-empty ranges, from minima of all runs of 1, 2, 4 … values."""
    if not len(low):
        return values[:0]
    level = np.frexp((high - low).astype(np.float64))[1].astype(np.int64) - 1
    n = len(values)
    runs = np.empty((int(level.max()) + 1, n), values.dtype)
    runs[0] = values
    for i in range(1, len(runs)):
        step, k = 1 << (i - 1), n - (1 << i) + 1
        np.minimum(runs[i - 1, :k], runs[i - 1, step:step + k], out=runs[i, :k])
    runs = runs.ravel()
    at = level * n
    return np.minimum(runs.take(at + low), runs.take(at + high - (np.int64(1) << level)))


def _inserted(data: np.ndarray, offsets: np.ndarray, cap: int):
    """``(entries, lcp)``: for every symbol from 0 on its places in the transform in
    order, as symbol * 2^32 + place; and the common prefixes."""
    begins, ends = offsets[:-1], offsets[1:]
    m = len(begins)
    before = lambda i, at: np.where(at > begins[i], data.take(np.maximum(at - 1, 0)) if len(data) else 0, 0).astype(np.int64) << 32
    entries = np.sort(before(np.arange(m), ends) | np.arange(m))
    lcp = np.zeros(m, np.uint8 if cap < 255 else np.int32)
    done = int(np.searchsorted(entries, 1 << 32))  # strings that are inserted whole: places of symbol 0
    who, k, j = (entries & _PLACE)[done:], np.arange(done, m), 0  # the others by their next suffix, and its entry
    while len(who):
        j += 1
        to, own = m - done + k, entries[k]
        # the neighbours among suffixes that start with the same symbol
        left, right = entries[k - 1], entries[np.minimum(k + 1, len(entries) - 1)]
        is_left = np.flatnonzero((k > 0) & (left >> 32 == own >> 32))
        is_right = (k + 1 < len(entries)) & (right >> 32 == own >> 32)
        is_right[:-1] &= k[1:] != k[:-1] + 1  # else it is one of this round too
        is_right = np.flatnonzero(is_right)
        place = own & _PLACE
        low = np.concatenate([left[is_left] & _PLACE, place[is_right]]) + 1
        high = np.concatenate([place[is_left], right[is_right] & _PLACE]) + 1
        shared = np.minimum(_minima(lcp, low, high), cap - 1) + 1
        # merge the round's suffixes into the two sequences
        n = len(entries) + len(k)
        old = np.ones(n, bool)
        old[to] = False
        moved = np.flatnonzero(old)
        new_lcp = np.empty(n, lcp.dtype)
        new_lcp[moved] = lcp
        new_lcp[to] = 0
        new_lcp[to[is_left]] = shared[:len(is_left)]
        new_lcp[to[is_right] + 1] = shared[len(is_left):]
        lcp = new_lcp
        moved -= np.arange(len(moved))
        entries += moved.take(entries & _PLACE)
        new = before(who, ends[who] - j) | to
        line = np.argsort(new)
        new = new[line]
        slot = np.searchsorted(entries, new) + np.arange(len(new))
        old[:], old[slot] = True, False
        merged = np.empty(n, np.int64)
        merged[old], merged[slot] = entries, new
        entries = merged
        over = int(np.searchsorted(new, 1 << 32))
        done += over
        who, k = who[line[over:]], slot[over:]
    return entries, lcp


def construct(data: np.ndarray, offsets: np.ndarray, cap: int):
    """``(bwt, lcp)`` over all suffixes of the strings ``data[offsets[i]:offsets[i+1]]``
    (symbols from 1; 0 ends every string, smaller for earlier strings).  The
    empty suffixes come first; ``lcp[k]`` is the common prefix of suffixes ``k - 1``
    and ``k``."""
    entries, lcp = _inserted(data, offsets, cap)
    bwt = np.empty(len(entries), data.dtype)
    bwt[entries & _PLACE] = entries >> 32
    return bwt, lcp


def columns(data: np.ndarray, offsets: np.ndarray, length: int):
    """Strings of columns ``(symbols, offsets, begin, width)`` out of byte strings: one for each of
    the first ``width`` bytes of a string that ``length`` bytes follow from, ``begin`` being where it lies.
    ``width`` divides ``length``, so that as many bytes agree as columns do."""
    width = max(w for w in range(1, WIDEST + 1) if length % w == 0) if data.dtype == np.uint8 else 1
    n = max(0, len(data) - width + 1)
    value = np.zeros(n, np.uint64)
    for i in range(width):
        value |= data[i:i + n].astype(np.uint64) << np.uint64(8 * i)
    symbol = pa.array(value).dictionary_encode().indices.to_numpy() + np.int32(1)
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    each = np.minimum(windows, width)
    phase = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    begin = np.repeat(offsets[:-1], each) + phase
    size = (np.repeat(offsets[1:], each) - begin) // width
    ends = np.concatenate([[0], np.cumsum(size)])
    return symbol.take(np.repeat(begin - ends[:-1] * width, size) + np.arange(ends[-1]) * width), ends, begin, width


def repeated(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """For every position of ``data`` whether the ``length`` symbols from it, inside
    its string, also start elsewhere in the collection: read off neighbours in
    the common prefixes, while the transform is inverted column by column."""
    out = np.zeros(len(data), bool)
    symbols, ends, begin, width = columns(data, offsets, length)
    if not len(symbols):
        return out
    least = length // width
    entries, lcp = _inserted(symbols, ends, least)
    same = lcp >= least
    same[:-1] |= same[1:]
    place = np.empty(len(entries), np.int64)
    place[entries & _PLACE] = np.arange(len(entries))
    size = np.diff(ends)
    at, last = np.arange(len(size)), begin + size * width
    for j in range(1, int(size.max()) + 1):
        active = np.flatnonzero(size >= j)
        at[active] = place[at[active]]
        if j >= least:
            out[last[active] - j * width] = same[at[active]]
    return out
