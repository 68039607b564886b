"""Benchmark decontamination with suffix arrays of the training text.

Every shard (a slice of a document partition) is numbered over the benchmark's
words, and its suffixes are sorted into a suffix array, ordered by their first
``window`` words.  Every benchmark suffix is binary-searched in it; a hit is
then extended word by word to the longest verbatim match, reported with its
place in the item and in the document.  Suffixes that cannot take part - their
first three words begin no benchmark suffix - stay out of the array, which
changes no answer and keeps the array small.

The benchmark is dealt into blocks of at most ``BLOCK_BYTES`` of text on
average by a hash of the item and its text; each block is indexed on the driver,
broadcast, and searched in a pass over the documents.  One block needs one pass
and no shuffle.  Several have a pass, and a written table of what it found, each:
neither the driver nor a task ever holds more than one block's index, however
large the benchmark is, and texts are read, not written again, for a pass.

A passage that many items and many documents share is expanded to its pairs in
portions of ``PAIRS``, each cut down to the starts of longest matches at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clickfeat.llm.common import staged
from clickfeat.llm.text import ALNUM, chain, parts, raw, words

BLOCK_BYTES = 16 << 20
SHARD_ROWS, SHARD_BYTES = 2000, 8 << 20
PAIRS = 1 << 20
UNKNOWN = np.uint32(0x7FFFFFFF)
MATCH = pa.struct([("item_id", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("length", pa.int64())])
MATCHES = "array<struct<item_id:long,item_word:long,doc_word:long,length:long>>"


class _Members:
    """A fixed set of 64-bit hashes with a cheap first look."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.values >> np.uint64(46)).astype(np.int64)] = True

    def find(self, h: np.ndarray):
        """Indices of the members in ``h`` and their ranks in the set."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(46)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        rank = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[rank] == h[at]
        return at[ok], rank[ok]


def _lay_out(ids: np.ndarray, first: np.ndarray, pad: int):
    """Word ids of all rows in one array with a 0 before, between and after
    them; and the position of each row's first word."""
    row_start = first[:-1] + np.arange(1, len(first))
    seq = np.zeros(len(ids) + len(first) + pad, np.uint32)
    seq[np.arange(len(ids)) + 1 + np.repeat(np.arange(len(first) - 1), np.diff(first))] = ids
    return seq, row_start


def _keys(seq: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    wide = np.ascontiguousarray(seq[at[:, None] + np.arange(window)].astype(">u4"))
    return wide.view(f"S{4 * window}").reshape(len(at)) if len(at) else np.zeros(0, f"S{4 * window}")


class TestIndex:
    """One benchmark block: its words numbered from 1, its sorted suffixes."""

    __test__ = False

    def __init__(self, item_ids: np.ndarray, texts: pa.Array, window: int):
        _, _, h, first = words(*raw(texts), ALNUM)
        self.window, self.items = window, item_ids
        self.vocabulary = _Members(h)
        ids = (np.searchsorted(self.vocabulary.values, h) + 1).astype(np.uint32)
        self.seq, self.row_start = _lay_out(ids, first, window)
        n = np.diff(first)
        self.full = np.concatenate([np.arange(s, s + c - window + 1) for s, c in zip(self.row_start, n) if c >= window]
                                   or [np.zeros(0, np.int64)])
        self.short = {int(c): self.row_start[n == c] for c in np.unique(n) if 0 < c < window}
        self.full_keys = _keys(self.seq, self.full, window)
        self.begin = {}
        for c, at in [*self.short.items(), (window, self.full)]:
            m = min(3, c)
            self.begin.setdefault(m, []).append(self._prefix(self.seq, at, m))
        self.begin = {m: _Members(np.concatenate(x)) for m, x in self.begin.items()}

    @staticmethod
    def _prefix(seq, at, m):
        return chain_rows(seq[at[:, None] + np.arange(m)]) if len(at) else np.zeros(0, np.uint64)

    def _runs(self, seq: np.ndarray):
        """The suffix array of the text ``seq`` and, for each kind of test suffix,
        its positions in the block, the bounds of its run in the array, and its length."""
        w = self.window
        known = np.flatnonzero((seq != 0) & (seq != UNKNOWN))
        chosen = [known[members.find(self._prefix(seq, known, m))[0]] for m, members in self.begin.items()]
        suffix = np.unique(np.concatenate(chosen)) if chosen else known[:0]
        keys = _keys(seq, suffix, w)
        order = np.argsort(keys, kind="stable")
        keys, suffix = keys[order], suffix[order]
        ends = [(self.full, self.full_keys, self.full_keys, w)]
        for c, at in self.short.items():
            low = self.seq[at[:, None] + np.arange(w)]
            low[:, c:] = 0
            high = low.copy()
            high[:, c:] = 0xFFFFFFFF
            ends.append((at, *(_keys(x.reshape(-1), np.arange(len(at)) * w, w) for x in (low, high)), c))
        runs = []
        for at, low, high, length in ends:
            a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            some = np.flatnonzero(b > a)
            runs.append((at[some], a[some], b[some], length))
        return suffix, runs

    def hits(self, seq: np.ndarray) -> np.ndarray:
        """The positions in the text where any window of the block begins."""
        suffix, runs = self._runs(seq)
        edge = np.zeros(len(suffix) + 1, np.int64)
        for _, a, b, _ in runs:
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)
        return suffix[np.cumsum(edge[:-1]) > 0]

    def search(self, seq: np.ndarray):
        """Longest matches with the text ``seq``: positions there, positions in
        the block, lengths."""
        suffix, runs = self._runs(seq)
        found = [(np.zeros(0, np.int64),) * 3]
        for at, a, b, length in runs:
            upto = np.concatenate([[0], np.cumsum(b - a)])
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
                c = b[lo:hi] - a[lo:hi]
                t = np.repeat(at[lo:hi], c)
                p = suffix[np.arange(len(t)) + np.repeat(a[lo:hi] - upto[lo:hi] + upto[lo], c)]
                fresh = (seq[p - 1] != self.seq[t - 1]) | (seq[p - 1] == 0)  # else part of a match that begins one word before
                found.append((p[fresh], t[fresh], np.full(int(fresh.sum()), length, np.int64)))
                lo = hi
        p, t, n = (np.concatenate(x) for x in zip(*found))
        grow = np.arange(len(p))
        while len(grow):
            x = seq[p[grow] + n[grow]]
            grow = grow[(x != 0) & (x == self.seq[t[grow] + n[grow]])]
            n[grow] += 1
        return p, t, n


def chain_rows(ids: np.ndarray) -> np.ndarray:
    """One hash for each row of a matrix of word ids."""
    return chain_columns([ids[:, j].astype(np.uint64) for j in range(ids.shape[1])])


def chain_columns(columns) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = chain((out ^ (c + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93), 1)
    return out


def _numbered(texts: pa.Array, block: TestIndex):
    """A shard's words as numbers of the block's: first word of each row, all
    numbers laid out, place of each row's first."""
    _, _, h, first = words(*raw(texts), ALNUM)
    ids = np.full(len(h), UNKNOWN, np.uint32)
    at, rank = block.vocabulary.find(h)
    ids[at] = rank + 1
    return first, *_lay_out(ids, first, block.window + 1)


def _scan(index):
    """Rows ``(id, text)`` -> ``id, n_words, n_hit, matches`` with this block."""
    def run(batches):
        block: TestIndex = index.value
        for part in (x for b in batches for x in parts(b, 1, SHARD_ROWS, SHARD_BYTES)):
            first, seq, start = _numbered(part.column(1), block)
            p, t, n = block.search(seq)
            doc = np.searchsorted(start, p, "right") - 1
            item = np.searchsorted(block.row_start, t, "right") - 1
            new = [block.items[item], t - block.row_start[item], p - start[doc], n]
            order = np.lexsort((new[1], new[0], new[2], doc))
            doc, new = doc[order], [x[order].astype(np.int64) for x in new]
            edge = np.zeros(len(seq) + 1, np.int64)
            np.add.at(edge, start[doc] + new[2], 1)
            np.add.at(edge, start[doc] + new[2] + new[3], -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
            n_words = np.diff(first)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(x) for x in new], fields=list(MATCH)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(hit[start + n_words] - hit[start], pa.int64()), lists],
                ["id", "n_words", "n_hit", "matches"])
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs (doc_id, text, ...)`` and ``benchmark (item_id, text, ...)`` -> one
    row per document row: ``doc_id, n_words, n_hit, matches, items``.

    ``matches`` lists the longest verbatim matches (``item_id``, first word in
    the item, first word in the document, words) that hold a whole window;
    ``n_hit`` counts the document words inside any; ``items`` are the distinct
    items with one.  An item shorter than the window is one window.  Null texts
    have no words; items without an id or words match nothing; repeated rows
    count each (documents) or once (benchmark); an empty benchmark
    leaves every document clean."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = f"id long, n_words long, n_hit long, matches {MATCHES}"
    blocks, indexes = _blocks(benchmark, window)
    if blocks == 1:
        out = own.mapInArrow(_scan(next(indexes)), names).withColumnRenamed("id", "doc_id")
    else:
        rows = staged(own.withColumn("id", F.monotonically_increasing_id()), "numbered")
        passes = None
        for index in indexes:
            found = rows.select("id", "text").mapInArrow(_scan(index), names)
            found = staged(found if passes is None else found.where("n_hit > 0"), "matches")
            passes = found if passes is None else passes.unionByName(found)
        merged = passes.groupBy("id").agg(F.max("n_words").alias("n_words"), _in_order(F.flatten(F.collect_list("matches"))).alias("matches"))
        out = rows.select("id", "doc_id").join(merged, "id").withColumn("n_hit", _covered(F.col("matches")))
    return out.select("doc_id", "n_words", "n_hit", "matches", F.array_distinct("matches.item_id").alias("items"))


def _in_order(matches: Column) -> Column:
    """By place in the document, then by item."""
    order = ("doc_word", "item_id", "item_word", "length")
    keyed = F.array_sort(F.transform(matches, lambda m: F.struct(*[m[c].alias(c) for c in order])))
    return F.transform(keyed, lambda m: F.struct(*[m[c].alias(c) for c in MATCH.names]))


def _covered(matches: Column) -> Column:
    """Words inside any of the matches, which are ordered by place."""
    zero = F.lit(0).cast("long")

    def more(acc, m):
        end = m["doc_word"] + m["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        (acc["n"] + F.greatest(zero, end - F.greatest(acc["end"], m["doc_word"]))).alias("n"))
    return F.aggregate(matches, F.struct(zero.alias("end"), zero.alias("n")), more, lambda acc: acc["n"])


def _blocks(benchmark: DataFrame, window: int):
    """How many blocks the benchmark has, and the blocks, indexed and broadcast one by one."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    blocks = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES) + 1

    def indexes():
        for i in range(blocks):
            block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).toArrow()
            yield spark.sparkContext.broadcast(TestIndex(block["item_id"].to_numpy().astype(np.int64), block["text"], window))
    return blocks, indexes()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The document rows without any hit, all columns kept as they are.  With one
    block this is a row filter; with several, each pass writes the rows it hit, and
    an anti-join by row number follows."""
    def hits(index, at):
        def run(batches):
            block: TestIndex = index.value
            for part in (x for b in batches for x in parts(b, at, SHARD_ROWS, SHARD_BYTES)):
                _, seq, start = _numbered(part.column(at), block)
                hit = np.zeros(part.num_rows, bool)
                hit[np.searchsorted(start, block.hits(seq), "right") - 1] = True
                yield part, hit
        return run

    def without(index, at):
        return lambda batches: (part.filter(pa.array(~hit)) for part, hit in hits(index, at)(batches))

    def hit_rows(index):
        return lambda batches: (part.select([0]).filter(pa.array(hit)) for part, hit in hits(index, 1)(batches))

    blocks, indexes = _blocks(benchmark, window)
    if blocks == 1:
        return docs.mapInArrow(without(next(indexes), docs.columns.index("text")), docs.schema)
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows, bad = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), None
    for index in indexes:
        found = staged(rows.select(row, "text").mapInArrow(hit_rows(index), f"`{row}` long"), "hits")
        bad = found if bad is None else bad.unionByName(found)
    return rows.join(bad, row, "left_anti").select(docs.columns)


def joined_digest(items: str) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)
