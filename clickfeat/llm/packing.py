"""Packing of documents into token sequences: shortest-pack-first over the
length histogram (Krell et al., "Efficient Sequence Packing without
Cross-contamination", 2021).

A document's ids (and its end id) are cut into pieces of at most ``capacity``,
all but the last full.  The histogram of piece lengths has at most ``capacity``
rows, whatever the corpus, and is all that the driver sees: lengths are placed
longest first, each into the packs that are shortest so far, by moving counts
between packing patterns.  Every pattern then owns ranges of ranks within its
lengths, and pieces find theirs by rank.

Ranks are local row numbers within (length, bucket of a row hash) plus the
bucket's offset, so a length that holds a third of all pieces is spread over
the buckets like any other.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clickfeat.llm.common import staged
from clickfeat.llm.text import parts
from clickfeat.llm.tokens import token_ids

CAPACITY = 2048
END = 1


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """``{length: pieces}`` -> ``[(packs, [(length, how many), ...]), ...]``.

    Longest lengths first; a piece goes to the shortest pack that has room, and
    opens a new pack where none has.  Packs with the same content are one entry
    with a count, which is split when only some of its packs get a piece."""
    room: dict[int, list] = defaultdict(list)  # left-over space -> [packs, content]

    def put(packs: int, content: list, length: int, space: int) -> None:
        if content and content[-1][0] == length:
            content = [*content[:-1], (length, content[-1][1] + 1)]
        else:
            content = [*content, (length, 1)]
        room[space - length].append([packs, content])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, packs in room.items() if packs and s >= length), default=None)
            if space is None:  # new packs, each filled with this length before the next is opened
                each = min(left, capacity // length)
                room[capacity - each * length].append([left // each, [(length, each)]])
                left %= each
                continue
            packs, content = room[space].pop()
            if packs > left:
                room[space].append([packs - left, content])
                packs = left
            put(packs, content, length, space)
            left -= packs
    return [(packs, content) for space in sorted(room) for packs, content in room[space]]


def places(pattern_list) -> dict[str, np.ndarray]:
    """One entry for each length of each pattern, sorted by (length, rank):
    ``packs`` neighbouring ranks fill one slot of the pattern's packs each."""
    taken, rows, sequence = defaultdict(int), [], 0
    for packs, content in pattern_list:
        offset = 0
        for length, many in content:
            rows.append((length, taken[length], packs, sequence, offset))
            taken[length] += packs * many
            offset += length * many
        sequence += packs
    rows.sort()
    names = ("length", "rank", "packs", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _cut(path: str, capacity: int):
    def run(batches):
        for b in (part for x in batches for part in parts(x, 1)):
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), token_ids(b.column(1), path)):
                data, n = np.append(ids, np.uint32(END)).astype("<u4"), len(ids) + 1
                out.extend((doc, a, min(capacity, n - a), zlib.crc32(data[a:a + capacity]), n) for a in range(0, n, capacity))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def _placed(table):
    def run(batches):
        t = table.value
        first = np.searchsorted(t["length"], np.arange(t["length"].max(initial=0) + 2))
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at, end = first[length], first[length + 1]
            while (some := end - at > 1).any():  # binary search among the entries of the own length
                mid = (at + end) // 2
                low = some & (t["rank"][np.minimum(mid, len(t["rank"]) - 1)] <= rank)
                at, end = np.where(low, mid, at), np.where(some & ~low, mid, end)
            r = rank - t["rank"][at]
            new = [t["sequence"][at] + r % t["packs"][at], t["offset"][at] + r // t["packs"][at] * length]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + [pa.array(x, pa.int64()) for x in new],
                                             [*b.schema.names[:-1], "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs (doc_id, text, ...)`` -> one row per piece: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is its end id alone; a null ``doc_id`` is packed as any
    other; repeated rows are packed each (equal rows may change places); other
    columns are ignored and an empty table packs nothing."""
    spark = docs.sparkSession
    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a piece's bucket is by its place, not by its id: pieces of one id, or of copies, are spread too
    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket")
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer_path, capacity), names)
    pieces = staged(cut.select("*", bucket), "pieces")
    counts = staged(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c")), "lengths")
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # <= capacity rows
    before = (F.sum("c").over(Window.partitionBy("length").orderBy("bucket")) - F.col("c")).alias("before")
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = (pieces.withColumn("local", local).join(counts.select("length", "bucket", before), ["length", "bucket"])
                    .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local") - 1).alias("rank")))
    table = spark.sparkContext.broadcast(places(patterns(histogram, capacity)))
    return ranked.mapInArrow(_placed(table), names + ", sequence_id long, offset long")
