"""How the sources of a language differ in their terms, priced from joint tables
of count levels.

A group is a (language, source).  Its smoothed share ``p`` of a term depends on
the group and the term's count in it alone, its *level*; levels are few where
counts are small.  In a block of terms every (group, level) that occurs is an
indicator column, one 1 a group in every row; the columns times their
transpose count, for every two columns, the terms that have both levels: the
joint table of every two groups at once.  A price is then needed once for each
cell that is not empty, and the value of a pair of groups is the sum of price
times count over its table.

Everything is exact: products count fewer rows than a 32-bit float can hold,
prices and sums are 64-bit integers, shares are computed in decimals.

On Spark: counts are summed within a batch of texts, then by term (hot terms
and hot sources are a row a task).  Kept terms are dealt into blocks by hash,
so a language with a third of all rows is spread over all tasks; within a block
terms of like count are neighbours, which keeps columns few.  Groups travel as
rows to every block of their language.  A task holds one buffer of terms and
one tile of a product, whatever the number of terms and groups.

Null text, language and source are empty; a row is a document, also where ids
repeat; extra columns are ignored; no rows give no groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from clickfeat.llm.common import staged
from clickfeat.llm.text import LETTERS, LOWER, raw, words

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SLICE_BYTES = 8 << 20
BUFFER = 1 << 16  # entries of a block of terms held at once
COLUMNS, TERMS = 1024, 4096  # of one tile of a product
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _slices(batch: pa.RecordBatch):
    """The rows of a batch in runs of about ``SLICE_BYTES`` of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _counted(batches):
    """Term counts of each group in a slice; a row without a term for the group itself."""
    for batch in batches:
        for part in _slices(batch):
            buf, offsets = raw(part.column("text"))
            start, end, h, first = words(buf, offsets, LETTERS)
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            groups, of_row = np.unique(pair, return_inverse=True)
            names = [lang.dictionary.take(pa.array(groups // len(source.dictionary))),
                     source.dictionary.take(pa.array(groups % len(source.dictionary)))]
            yield pa.RecordBatch.from_arrays([*names, pa.nulls(len(names[0]), pa.string()), *[pa.array(np.zeros(len(names[0]), np.int64))] * 2], schema=_COUNTS)
            if not len(h):
                continue
            _, at, term = np.unique(h, return_index=True, return_inverse=True)
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            cell, n = np.unique(row * len(at) + term, return_counts=True)  # a term in a document
            key, back = np.unique(of_row[cell // len(at)] * len(at) + cell % len(at), return_inverse=True)
            order = np.argsort(back, kind="stable")
            edge = np.searchsorted(back[order], np.arange(len(key)))
            text = LOWER[buf]
            terms = pa.array([text[a:b].tobytes() for a, b in zip(start[at], end[at])], pa.binary()).cast(pa.string())
            g = pa.array(key // len(at))
            yield pa.RecordBatch.from_arrays([names[0].take(g), names[1].take(g), terms.take(pa.array(key % len(at))),
                                              pa.array(np.add.reduceat(n[order], edge)), pa.array(np.diff(edge, append=len(back)))], schema=_COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n`` (occurrences), ``df`` (documents), and a row with
    null term for every group."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    parts = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: str, total: str) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))`` in decimals."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    num, den = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 1), wide(total) + wide("terms")
    return F.when(F.col("terms") > 0, F.lit(1) + F.call_function("div", num, F.nullif(den, F.lit(0).cast("decimal(21,0)")))).otherwise(0)


def price(p, q):
    return (p - q) * (p - q) // q


def _tiles(group: np.ndarray):
    """Column ranges of up to ``COLUMNS`` columns that end where a group ends (a
    group with more is a range of its own)."""
    ends = [int(x) + 1 for x in np.flatnonzero(np.diff(group, append=-1))]
    at, out = 0, []
    for end, following in zip(ends, [*ends[1:], None]):
        if following is None or following - at > COLUMNS:
            out.append((at, end))
            at = end
    return out


def joint_prices(levels: np.ndarray):
    """``levels[term, group]`` (shares) -> ``(i, j, values)`` tiles: the groups of the
    tile's rows and columns and, for each two, the summed price of the first
    against the second over all terms."""
    if len(levels) > 32 and sum(len(np.unique(c)) for c in levels.T) > COLUMNS:
        half = len(levels) // 2
        yield from joint_prices(levels[:half])
        yield from joint_prices(levels[half:])
        return
    share, group, hot = [], [], np.empty(levels.shape, np.int64)
    for g, column in enumerate(levels.T):
        values, back = np.unique(column, return_inverse=True)
        hot[:, g] = back + sum(map(len, share))
        share.append(values)
        group.append(np.full(len(values), g))
    share, group = np.concatenate(share), np.concatenate(group)
    x = np.zeros((len(levels), len(share)), np.float32)
    x[np.arange(len(levels))[:, None], hot] = 1
    tiles = _tiles(group)
    for a, b in tiles:
        for c, d in tiles:
            joint = x[:, a:b].T @ x[:, c:d]
            i, j = np.nonzero(joint)
            value = np.zeros(joint.shape, np.int64)
            value[i, j] = price(share[a + i], share[c + j]) * joint[i, j].astype(np.int64)
            gi, si = np.unique(group[a:b], return_index=True)
            gj, sj = np.unique(group[c:d], return_index=True)
            yield gi, gj, np.add.reduceat(np.add.reduceat(value, si, axis=0), sj, axis=1)


_PRICED = pa.schema([("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("value", pa.int64())])


def _rows(lang, i, j, value):
    return pa.RecordBatch.from_arrays([pa.array([lang] * value.size, pa.string()), pa.array(np.repeat(i, len(j))),
                                       pa.array(np.tile(j, len(i))), pa.array(value.ravel())], schema=_PRICED)


def _products(batches):
    """A partition's blocks: first the groups of a block's language with the share
    of an absent term, then the counts of its terms, term by term."""
    lang = block = last = None
    zero, held, number = [], [], 0

    def flush(all_terms):
        """The products of the buffered terms; the last one may not be complete."""
        if not held:
            return
        row, g, p = (np.concatenate(x) for x in zip(*held))
        held.clear()
        if not all_terms:
            cut = int(np.searchsorted(row, row[-1]))
            held.append((row[cut:], g[cut:], p[cut:]))
            row, g, p = row[:cut], g[:cut], p[:cut]
        levels, step = np.array(zero, np.int64), max(1, min(TERMS, (1 << 21) // len(zero)))
        for first in range(int(row[0]), int(row[-1]) + 1, step) if len(row) else ():
            a, b = np.searchsorted(row, [first, first + step])
            part = np.tile(levels, (int(row[b - 1]) - first + 1, 1))
            part[row[a:b] - first, g[a:b]] = p[a:b]
            for i, j, value in joint_prices(part):
                yield _rows(lang, i, j, value)

    def finish():
        yield from flush(True)
        if block == 0:  # every two groups have a row, with or without terms
            n = np.arange(len(zero))
            for at in range(0, len(n), COLUMNS):
                i = n[at:at + COLUMNS]
                yield _rows(lang, i, n, np.zeros((len(i), len(n)), np.int64))

    def differs(a):
        return ~pc.fill_null(pc.equal(a[1:], a[:-1]), False).to_numpy(zero_copy_only=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        names, terms = batch.column("lang"), batch.column("term")
        blocks, kind, g, p = (batch.column(c).to_numpy() for c in ("block", "kind", "sid", "p"))
        cuts = [0, *np.flatnonzero(differs(names) | (blocks[1:] != blocks[:-1])) + 1, batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            a, b = int(a), int(b)
            if (names[a].as_py(), int(blocks[a])) != (lang, block):
                yield from finish()
                lang, block, last, zero, number = names[a].as_py(), int(blocks[a]), None, [], 0
            c = a + int((kind[a:b] == 0).sum())
            zero += p[a:c].tolist()
            if c == b:
                continue
            mine = terms.slice(c, b - c)
            row = number + np.cumsum(np.concatenate([[mine[0].as_py() != last], differs(mine)]))
            held.append((row, g[c:b], p[c:b]))
            last, number = mine[len(mine) - 1].as_py(), int(row[-1])
            if sum(len(x[0]) for x in held) >= BUFFER:
                yield from flush(False)
    yield from finish()


def divergence(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``docs (lang, source, text)`` -> ``lang, source, part, item, value, rank``: for
    every group, ``pair`` rows with its divergence from each other source of the
    language and ``term`` rows with the ``top`` terms that set it off from the
    language as a whole."""
    spark = docs.sparkSession
    counts = staged(term_counts(docs), "term-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n"))
    terms = terms.where(F.col("df") >= LEAST_DOCUMENTS).drop("df")
    kept = staged(counts.where("term is not null").drop("df").join(terms, ["lang", "term"]), "kept-terms")
    of_lang = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    sid = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = staged(groups.withColumn("sid", sid), "term-groups")
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")})

    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = F.row_number().over(by_value).alias("rank")
    p, q = F.col("p"), F.col("q")
    apart = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         F.call_function("div", (p - q) * (p - q), q).alias("value"))
    apart = apart.select("*", ranked).where(F.col("rank") <= top)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_term = shares.select("lang", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("block"), F.lit(1).alias("kind"), "sid", "p", "lang_n", "term")
    of_group = (groups.withColumn("zero", F.lit(0)).withColumn("p", _share("zero", "total"))
                .select("lang", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(0).alias("kind"), "sid", "p",
                        F.lit(None).cast("long").alias("lang_n"), F.lit(None).cast("string").alias("term")))
    dealt = (of_group.unionByName(of_term).repartition(n, "lang", "block")
             .sortWithinPartitions("lang", "block", "kind", F.col("lang_n").desc(), "term", "sid"))
    priced = dealt.drop("lang_n").mapInArrow(_products, "lang string, i long, j long, value long")
    priced = priced.groupBy("lang", "i", "j").agg(F.sum("value").alias("value")).where("i <> j")
    name = lambda c, to: groups.select("lang", F.col("sid").alias(c), F.col("source").alias(to))
    pairs = priced.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", ranked)
    return pairs.unionByName(apart)
