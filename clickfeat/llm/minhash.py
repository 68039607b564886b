"""Near-duplicate documents by circulant MinHash (Li & Li, "C-MinHash", 2022).

A document's set holds the hashes of its distinct word shingles.  One
permutation ``sigma`` (a bijective mix, then the low bits) gives every shingle
a position on a circle; a second one, ``pi``, is a fixed table on that circle,
and coordinate ``k`` of the signature is the least ``pi`` value over the set
with ``pi`` shifted by ``k``.  So all coordinates of a shingle are one run of
neighbouring table cells.

1. Documents with equal sets form one class (a digest of the sorted set), and
   only classes go on: exact copies cost one partial aggregate.
2. Signature bands are bucketed; every member of a bucket is paired with its
   hub, the member that shares most buckets (linear in the bucket, whatever its
   size), and the pair is verified on the full sets.  Links become components.
3. A hub's cell is all that ever shared a bucket with it.  Where a cell still
   holds several components there may be links away from the hub, so members
   outside the hub's component are compared with the whole cell: in blocks of
   bounded size, by matrix products inside a task that returns a spanning set
   of the links it finds.  No pair becomes a row.

Bands of 5 out of 200 coordinates, 40 of them: a pair at similarity 0.8 shares
no bucket with probability below 2e-7.  Links are exact (on 64-bit shingle
hashes); nothing is capped.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickfeat.llm.common import staged
from clickfeat.llm.components import components
from clickfeat.llm.text import SPACED, chain, mix, parts, raw, words

CIRCLE = 1 << 20
ROWS, BANDS = 5, 40
SIMILARITY = 80  # per cent


@lru_cache(maxsize=1)
def _pi() -> np.ndarray:
    """Row ``p``: the table cells that a shingle at position ``p`` meets under
    shifts 0, 1, 2, ... (a view; the table itself is held once)."""
    table = np.random.default_rng(20220906).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:ROWS * BANDS]]), ROWS * BANDS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The ``ROWS * BANDS`` coordinates of a non-empty set of 64-bit hashes."""
    at = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(CIRCLE)).astype(np.int64)
    best, run = None, _pi()
    for i in range(0, len(at), 1024):
        low = run[at[i:i + 1024]].min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def shingle_sets(texts: pa.Array, k: int):
    """For each text its sorted distinct hashes of ``k`` consecutive words, or
    of the whole sequence where there are fewer."""
    buf, offsets = raw(texts)
    _, _, h, first = words(buf, offsets, SPACED)
    runs = chain(h, k)
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        yield np.unique(runs[a:b - k + 1]) if n >= k else chain(h[a:b], int(n)) if n else h[:0]


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(k: int):
    def run(batches):
        for b in batches:
            for part in parts(b, 1):
                node, n, keys = [], [], []
                for s in shingle_sets(part.column(1), k):
                    n.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    keys.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(node, pa.int64()), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32),
                                              pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))],
                    ["doc_id", "h", "node", "n", "bands"])
    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            for part in parts(b, 0, 500):
                node, sets = [], []
                for s in shingle_sets(part.column(0), k):
                    if len(s):
                        node.append(_node(s))
                        sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                                 ["node", "shingles"])
    return run


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are similar enough.  Pairs that could
    not be by their sizes alone go no further than those."""
    size = sets.select("node", "n")
    p = (pairs.join(size.toDF("u", "nu"), "u").join(size.toDF("v", "nv"), "v")
              .where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * SIMILARITY))
    full = sets.select("node", "shingles")
    both = (p.join(full.toDF("u", "su"), "u").join(full.toDF("v", "sv"), "v")
             .withColumn("same", F.size(F.array_intersect("su", "sv"))))
    return both.where(F.col("same") * 100 >= (F.col("nu") + F.col("nv") - F.col("same")) * SIMILARITY).select("u", "v")


BLOCK_SHINGLES, BLOCK_SETS, COLUMNS = 1 << 18, 1024, 1024


def _links_between(left, right):
    """A spanning set of the links between two lists of ``(node, root, set)``
    that join different roots."""
    rows = [*left, *right]
    flat = np.concatenate([s for _, _, s in rows])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # a shingle of one set alone adds to no intersection
    owner = np.repeat(np.arange(len(rows)), [len(s) for _, _, s in rows])
    keep = times[column] > 1
    column, owner = shared[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    same = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        has = np.zeros((len(rows), COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        same += has[:len(left)] @ has[len(left):].T
    n = np.array([len(s) for _, _, s in rows], np.float64)
    same = same.astype(np.float64)
    similar = same * 100 >= (n[:len(left), None] + n[None, len(left):] - same) * SIMILARITY
    head: dict[int, int] = {}

    def find(r):
        while head.get(r, r) != r:
            r = head[r]
        return r
    for i, j in np.argwhere(similar):
        a, b = find(left[i][1]), find(right[j][1])
        if a != b:
            head[max(a, b)] = min(a, b)
            yield left[i][0], right[j][0]


def _cells(batches):
    """Rows sorted by (hub, i, j): the sets of two blocks of a cell each."""
    names = ["hub", "i", "j", "left", "right", "node", "root", "shingles"]

    def links(rows):
        left, right = ([(n, r, s) for side, n, r, s in rows if side[k]] for k in (0, 1))
        found = list(_links_between(left, right)) if left and right else []
        return [u for u, _ in found], [v for _, v in found]

    key, rows, out = None, [], ([], [])
    for b in batches:
        shingles = b.column("shingles")
        flat, cut = shingles.flatten().to_numpy(), shingles.offsets.to_numpy()
        base = cut[0]
        for r, (hub, i, j, left, right, node, root) in enumerate(zip(*(b.column(c).to_pylist() for c in names[:-1]))):
            if key != (hub, i, j):
                for a, x in zip(out, links(rows)):
                    a.extend(x)
                key, rows = (hub, i, j), []
            rows.append(((left, right), node, root, flat[cut[r] - base:cut[r + 1] - base].copy()))
    for a, x in zip(out, links(rows)):
        a.extend(x)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "v"])


def _across(cells: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within cells ``(hub, node)`` that join different roots."""
    home = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    t = (cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
              .join(home, "hub", "left").withColumn("out", F.col("root") != F.coalesce("hub_root", "hub"))
              .join(sets.select("node", "n"), "node"))
    blocks = lambda own: F.ceil(F.greatest(F.sum(F.when(own, F.col("n"))) / BLOCK_SHINGLES,
                                           F.count(F.when(own, 1)) / BLOCK_SETS)).cast("int")
    size = t.groupBy("hub").agg(blocks(F.col("out")).alias("outs"), F.coalesce(blocks(~F.col("out")), F.lit(0)).alias("ins")).where("outs > 0")
    t = t.join(size, "hub")
    own = F.when(F.col("out"), F.pmod("node", F.col("outs"))).otherwise(F.col("outs") + F.pmod("node", F.greatest("ins", F.lit(1)))).cast("int")
    # a member outside meets every block, one inside the outer blocks; a block pair is (outer i, any j >= i)
    others = F.sequence(F.lit(0), F.when(F.col("out"), F.col("outs") + F.col("ins") - 1).otherwise(F.col("outs") - 1))
    t = t.withColumn("own", own).withColumn("other", F.explode(others))
    t = t.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                 (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "node", "root")
    t = t.join(sets.select("node", "shingles"), "node")
    return (t.select("hub", "i", "j", "left", "right", "node", "root", "shingles").repartition("hub", "i", "j")
             .sortWithinPartitions("hub", "i", "j").mapInArrow(_cells, "u long, v long"))


def _grouped(docs: DataFrame, k: int, linked) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs (doc_id, text)`` -> its rows (``doc_id``, text hash ``h``, ``node``,
    ``n``), the classes of those where ``linked`` (a condition) holds with the
    ``first`` of their rows by (id, text hash), null ids last, and the roots of
    all classes that have a link."""
    rows = staged(docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
                      .mapInArrow(_signed(k), "doc_id long, h long, node long, n long, bands array<long>"), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    classes = staged(rows.where((F.col("n") > 0) & linked).groupBy("node")
                         .agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")),
                     "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = staged(banded.join(shared, "band"), "buckets")
    central = met.groupBy("node").agg(F.sum("c").alias("met"))
    ranked = met.select("band", "node").join(central, "node").withColumn("rank", F.struct("met", "node"))
    hubs = ranked.groupBy("band").agg(F.max("rank").alias("hub")).select("band", F.col("hub.node").alias("hub"))
    cells = staged(met.select("band", "node").join(hubs, "band").select("hub", "node").distinct(), "cells")
    # the full sets of all that met: their texts are read again
    wanted = classes.select("node", "first", "n").join(central.select("node"), "node", "left_semi")
    named = wanted.select("first.id", "first.h").distinct().hint("merge")  # the same plan at every size
    texts = docs.join(named, docs["doc_id"].eqNullSafe(named["id"]) & (F.xxhash64(docs["text"]) == named["h"]), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(k), "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = staged(sets.join(wanted.select("node", "n"), "node"), "sets")
    links = staged(_similar(cells.where("hub <> node").toDF("u", "v"), sets), "links")
    roots = staged(components(links), "roots")
    more = staged(_across(cells, roots, sets), "links")
    if not more.isEmpty():
        roots = staged(components(links.unionByName(more)), "roots")
    return rows, classes, roots


def near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs (doc_id, text, ...)`` -> one row per document: ``doc_id,
    n_shingles, component_id, kept``.

    Null and wordless texts have an empty set and no link.  A null ``doc_id``
    is kept and belongs to no component (``component_id`` null); rows repeated
    under one ``doc_id`` each get a row.  Other columns are ignored; an empty
    table gives an empty result."""
    rows, classes, roots = _grouped(docs.select("doc_id", "text"), k, F.col("doc_id").isNotNull())
    classes = classes.select("node", F.col("first.id").alias("doc_id"))
    linked = classes.select("node", "doc_id").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # every class with its component: a class without links is its own
    named = (classes.select("node", F.col("doc_id").alias("least")).join(roots, "node", "left").join(least, "root", "left")
                    .select("node", F.coalesce("component_id", "least").alias("component_id")))
    out = rows.select("doc_id", "node", "n").join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row of each group of near-duplicate texts, all columns as they are:
    the first by (``doc_id``, text hash), null ids last.

    Rows are compared by their texts alone: a shared ``doc_id`` neither groups
    nor removes rows, and rows without one are compared as all others.  Of rows
    with equal id and text one stays, by a hash of its columns (maps and variants
    left out).  Null and wordless texts have no near-duplicate and all stay."""
    rows, classes, roots = _grouped(docs.select("doc_id", "text"), k, F.lit(True))
    firsts = (classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
                     .select(F.col("first.id").alias("__own"), F.col("first.h").alias("__first")))
    texts = rows.where("n > 0").groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.count(F.lit(1)).alias("__rows"))
    # merge joins: the texts grow with the corpus, so the plan is the same at every size
    own = F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__h") == F.col("__first"))
    state = staged(texts.join(firsts.hint("merge"), own, "left").select("__id", "__h", "__rows", F.col("__first").isNotNull().alias("__kept")), "kept")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h"))
    once = docs.join(state.where("not __kept or __rows > 1").select("__id", "__h").hint("merge"), same, "left_anti")
    again = docs.join(state.where("__kept and __rows > 1").select("__id", "__h"), same, "left_semi")
    plain = [f.name for f in docs.schema if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
    again = (again.groupBy(docs["doc_id"].alias("__id"), F.xxhash64(docs["text"]).alias("__h"))
                  .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("__row")).select("__row.*"))
    return once.unionByName(again)
