"""Removal of byte strings that repeat across a corpus, by suffix sorting.

Texts are cut into short strings so that equal ``length``-byte windows always
meet in one task.  A window's anchor is its least hashed gram, so it depends on
the window's bytes alone; neighbouring windows with one anchor, at places of one
block of ``width``, form a *piece* (up to ``length + width - 1`` bytes), and the
bytes common to all windows that a block can hold are its core.  A piece is
dealt by (anchor's block, core): equal windows have equal keys, and a key that
occurs once holds nothing that repeats.

Equal pieces of a key form a class, which enters the collection as one string
with its number of occurrences.  Batches of whole keys then go through the
column-wise construction (``collection``): one column of eight bytes of every
piece a round, transform and common prefixes read and rewritten front to back.
A window repeats if its suffix shares ``length`` bytes with a neighbour's, or if
its class holds several pieces.  No folder of a task's machine is used: the
sequential files of the construction are the bounded buffers of a batch.

A key with more than ``HOT`` classes (a passage that meets many different
surroundings) is cut again with blocks of the next width: its core is longer,
so different surroundings get different keys.  The last width is one window a
piece, where a key is one class; no key is ever one task's alone.

Pieces are found by 64-bit hashes of core and piece (a class mixes texts only
if both collide).  Null text is empty; a row is a document, also where ids
repeat; texts shorter than ``length`` repeat nothing; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from clickfeat.llm.collection import repeated
from clickfeat.llm.common import staged_at
from clickfeat.llm.text import mix, raw
from clickfeat.session import drop_scratch

LENGTH = 200
GRAM = 9
WIDTHS = (96, 12, 1)
HOT = 2048  # classes of a key
BATCH_BYTES = 1 << 17  # the sequences of a batch stay in a core's cache
CHUNK = 1 << 19
SLICE_BYTES = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_AT = _U((1 << 21) - 1)


@lru_cache(maxsize=1)
def _constants(n: int):
    p, q = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q), mix(np.arange(256, dtype=np.uint64) + _U(0x51ED270))


def _window_minima(v: np.ndarray, n: int) -> np.ndarray:
    """``min(v[i:i + n])`` for every ``i``, from minima to both sides of every n-th place."""
    size = -(-len(v) // n) * n
    block = np.full(size, ~_U(0))
    block[:len(v)] = v
    block = block.reshape(-1, n)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    k = len(v) - n + 1
    return np.minimum(behind[:k], ahead[n - 1:n - 1 + k])


def pieces(buf: np.ndarray, offsets: np.ndarray, length: int, width: int):
    """``(row, at, n, key, digest)`` of the pieces of texts: byte offset in the text,
    number of windows, and hashes of the block's core and of the piece."""
    gram = min(GRAM, length)
    span = length - gram + 1  # places an anchor can have in a window
    out = []
    starts, ends = offsets[:-1], offsets[1:]
    usable = np.flatnonzero(ends - starts >= length)
    power, inverse, value = _constants(CHUNK + 4 * LENGTH + length)
    first, last = (int(starts[usable[0]]), int(ends[usable[-1]]) - length + 1) if len(usable) else (0, 0)
    for a in range(first, last, CHUNK):
        b = min(last, a + CHUNK)  # windows that start in [a, b)
        data = buf[a:b + length - 1]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * power[:len(data)], out=sums[1:])
        hashed = lambda i, j: (sums[j] - sums[i]) * inverse[i]
        i = np.arange(len(data) - gram + 1)
        grams = mix((sums[gram:] - sums[:-gram]) * inverse[:len(i)])
        least = _window_minima((grams & ~_AT) | i.astype(np.uint64), span)
        s = np.arange(b - a)
        x = (least & _AT).astype(np.int64)
        block = (x - s) // width
        inside = np.zeros(b - a + 1, np.int64)  # windows that do not cross the end of a text
        np.add.at(inside, np.clip(starts[usable] - a, 0, b - a), 1)
        np.add.at(inside, np.clip(ends[usable] - length + 1 - a, 0, b - a), -1)
        inside = np.cumsum(inside[:-1]) > 0
        edge = inside.copy()
        edge[1:] = (inside[1:] != inside[:-1]) | (inside[1:] & ((x[1:] != x[:-1]) | (block[1:] != block[:-1])))
        edge = np.flatnonzero(edge)
        begins = inside[edge]
        at, stop = edge[begins], np.append(edge[1:], b - a)[begins]
        n, k = stop - at, block[at]
        low = x[at] - k * width
        high = x[at] - np.minimum(k * width + width - 1, span - 1) + length
        key = mix(mix(hashed(low, high)) + (k * 1_000_003 + width).astype(np.uint64))
        digest = mix(hashed(at, stop + length - 1) ^ (n.astype(np.uint64) << _U(40)))
        row = np.searchsorted(starts, at + a, "right") - 1
        out.append((row, at + a - starts[row], n, key.view(np.int64), digest.view(np.int64)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


PIECE = "rid long, at long, n int, key long, digest long"
_PIECE = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("digest", pa.int64())])


def _slices(batch: pa.RecordBatch, column: str):
    ends = np.diff(raw(batch.column(column))[1]).cumsum()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _cutter(length: int, width: int):
    """Rows ``(rid, base, bytes)`` -> pieces, ``base`` being where the bytes lie in their text."""
    def cut(batches):
        for batch in batches:
            for part in _slices(batch, "bytes"):
                buf, offsets = raw(part.column("bytes"))
                row, at, n, key, digest = pieces(buf, offsets, length, width)
                rid, base = (part.column(c).to_numpy() for c in ("rid", "base"))
                yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(base[row] + at), pa.array(n.astype(np.int32)),
                                                  pa.array(key), pa.array(digest)], schema=_PIECE)
    return cut


def _fetch(batches):
    """Bytes of wanted pieces out of their texts."""
    for batch in batches:
        for part in _slices(batch, "bytes"):
            buf, offsets = raw(part.column("bytes"))
            wanted = part.column("wanted")
            item, row = wanted.flatten(), np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            all_ends = np.cumsum(item.field("size").to_numpy())
            a = 0
            while a < len(item):  # pieces overlap, so they are more bytes than the texts
                b = max(a + 1, int(np.searchsorted(all_ends, (all_ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
                at, size = (item.field(c).to_numpy()[a:b] for c in ("at", "size"))
                low, ends = offsets[:-1][row[a:b]] + at, np.concatenate([[0], np.cumsum(size)])
                index = np.arange(ends[-1]) + np.repeat(low - ends[:-1], size)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf[index])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("rid").to_numpy()[row[a:b]]), pa.array(at), *[item.field(c)[a:b] for c in ("key", "digest", "count")],
                     data.cast(pa.binary())], names=["rid", "base", "key", "digest", "count", "bytes"])
                a = b


def _compared(length: int):
    """Pieces sorted by key -> the windows of each that repeat, as bits (pieces
    without one are left out)."""
    def solved(held):
        whole = pa.Table.from_batches(held).combine_chunks()
        buf, offsets = raw(whole.column("bytes"))
        flags = repeated(buf, offsets, length)
        bits = [np.packbits(flags[a:b - length + 1] | (c > 1), bitorder="little").tobytes()
                for a, b, c in zip(offsets, offsets[1:], whole.column("count").to_numpy())]
        some = np.array([any(x) for x in bits])
        key, digest = (whole.column(c).to_numpy()[some] for c in ("key", "digest"))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(digest), pa.array([x for x, y in zip(bits, some) if y], pa.binary())],
                                          names=["key", "digest", "bits"])

    def compare(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ends = batch.column("key").to_numpy(), raw(batch.column("bytes"))[1]
            starts = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
            a, last = 0, key[-1]
            while a < len(key):
                full = starts[(starts >= a) & (ends[starts] - ends[a] + size >= BATCH_BYTES)]
                b = int(full[0]) if len(full) else len(key)
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += int(ends[b] - ends[a])
                if len(full):
                    yield solved(held)
                    held, size = [], 0
                a = b
        if held:
            yield solved(held)
    return compare


def _spans(length: int):
    """Texts and the repeated windows of their pieces -> what goes and what stays."""
    def remove(batches):
        for batch in batches:
            for part in _slices(batch, "bytes"):
                buf, offsets = raw(part.column("bytes"))
                marks = part.column("marks")
                item, row = marks.flatten(), np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
                bits, ends = raw(item.field("bits"))
                hit = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
                of = np.searchsorted(ends * 8, hit, "right") - 1
                at = (offsets[:-1][row] + item.field("at").to_numpy())[of] + hit - ends[of] * 8
                n = len(buf) + 1
                gone = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + length, minlength=n)) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                first, last = gone[:-1].copy(), gone[:-1].copy()
                first[1:] &= ~gone[:-2]
                last[:-1] &= ~gone[1:-1]
                inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(buf))]
                first[inner] = gone[inner]
                last[inner - 1] = gone[inner - 1]
                start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
                cut = np.searchsorted(start, offsets)
                shift = np.repeat(offsets[:-1], np.diff(cut))
                spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(start - shift), pa.array(end - shift)], ["start", "end"]))
                left = (offsets - total[offsets]).astype(np.int64)
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(left), pa.py_buffer(buf[~gone[:-1]])])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), spans, kept.cast(pa.binary())],
                                                 names=["doc_id", "n_bytes", "spans", "kept"])
    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs (doc_id, text)`` -> ``doc_id, n_bytes, spans (array of start, end), kept
    (binary)``: without every byte that is covered by a ``length``-byte string
    which starts at another place of the corpus too."""
    texts, _ = staged_at(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes")), "texts")
    marks, found = None, texts.select("rid", F.lit(0).cast("long").alias("base"), "bytes").mapInArrow(_cutter(length, WIDTHS[0]), PIECE)
    spark, done = docs.sparkSession, []  # folders that nothing reads any more
    for width, finer in zip(WIDTHS, [*WIDTHS[1:], None]):
        found, pieces_at = staged_at(found, "pieces")
        for path in done:
            drop_scratch(spark, path)
        # a table of its own, so that the join is between two plain shuffles and hot keys are split
        keys, keys_at = staged_at(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys")
        found, found_at = staged_at(found.join(keys, "key", "left_semi"), "repeated-keys")
        for path in (pieces_at, keys_at):
            drop_scratch(spark, path)
        one = F.struct("rid", "at", "n")
        classes, classes_at = staged_at(found.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("count"), F.min(one).alias("one")), "classes")
        hot = None
        if finer:
            hot, _ = staged_at(classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("key"), "hot-keys")
            hot = None if hot.isEmpty() else hot
        cold = classes if hot is None else classes.join(hot, "key", "left_anti")
        strings = _bytes(texts, cold.select("one.rid", "one.at", "one.n", "key", "digest", "count"), length)
        strings = strings.select("key", "digest", "count", "bytes").repartition("key").sortWithinPartitions("key", "digest")
        bits = strings.mapInArrow(_compared(length), "key long, digest long, bits binary")
        mine, _ = staged_at(found.join(bits, ["key", "digest"]).select("rid", "at", "bits"), "repeated-windows")
        marks = mine if marks is None else marks.unionByName(mine)
        drop_scratch(spark, classes_at)
        if hot is None:
            drop_scratch(spark, found_at)
            break
        done = [found_at]  # the next pieces are cut from it
        again = found.join(hot, "key", "left_semi").withColumn("count", F.lit(1).cast("long"))
        found = _bytes(texts, again, length).select("rid", "base", "bytes").mapInArrow(_cutter(length, finer), PIECE)
    marks = marks.groupBy(F.col("rid").alias("of")).agg(F.collect_list(F.struct("at", "bits")).alias("marks"))
    return (texts.join(marks, F.col("rid") == F.col("of"), "left").select("doc_id", "bytes", "marks")
            .mapInArrow(_spans(length), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"))


def _bytes(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``rid, base, key, digest, count, bytes`` of pieces ``(rid, at, n, key, digest, count)``."""
    item = F.struct("at", (F.col("n") + (length - 1)).cast("long").alias("size"), "key", "digest", "count")
    of = wanted.groupBy("rid").agg(F.collect_list(item).alias("wanted"))
    return texts.join(of, "rid").select("rid", "bytes", "wanted").mapInArrow(
        _fetch, "rid long, base long, key long, digest long, count long, bytes binary")
