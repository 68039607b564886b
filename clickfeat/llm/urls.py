"""URL filters by Bloom filter cascades (Larisch et al., "CRLite", 2017).

A list of keys is encoded against the complete universe of keys that the corpus
can ask for.  Level 0 holds the listed keys; level 1 holds the other keys that
level 0 mistakes for listed; level 2 the listed keys that level 1 mistakes, and
so on, until a level makes no mistake.  Over that universe the cascade answers
membership exactly, with no join at all.

The universe is the distinct set of (host suffix, path prefix) pairs of all
URLs, of the shapes that occur in the lists.  Each level is a fixed number of
64-bit words, a multiple of the list's size and of the logarithm of the universe's;
it is filled by an aggregate and then broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickfeat.llm.common import staged
from clickfeat.llm.text import mix

LISTED = 5_000_000  # the longest list that is broadcast


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = _rest(url)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower()), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substr(F.col(url), at + 3))


def keys_of(host: Column, path: Column, shapes) -> Column:
    """The keys a URL has in the given shapes (labels of the host suffix, length
    of the path prefix)."""
    made = []
    for labels, prefix in sorted(shapes):
        suffix = F.substring_index(host, ".", -labels)
        there = (host != "") & (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= prefix)
        made.append(F.when(there, F.concat(suffix, F.substring(path, 1, prefix))))
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


class Level:
    def __init__(self, n: int, rate: float, salt: int):
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = 64 * (1 + int(max(1, n) * -math.log2(rate) * 1.4427 / 64))
        self.salt, self.words = salt, np.zeros(self.bits // 64, np.uint64)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i = np.arange(self.hashes, dtype=np.uint64)
        salt = mix(np.array([self.salt + 1], np.uint64))
        return mix((a[:, None] ^ salt) + b[:, None] * (i + np.uint64(1))) % np.uint64(self.bits)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = self.places(a, b)
        return ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


def member(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe the cascade was built over."""
    found, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for i, level in enumerate(levels):
        has = level.has(a[open_], b[open_])
        found[open_[~has]] = i % 2 == 1
        open_ = open_[has]
    found[open_] = len(levels) % 2 == 1
    return found


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), F.col(key)).alias("b")]


def _longs(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _filled(keys: DataFrame, level: Level) -> Level:
    """The level with all ``keys (a, b)`` in it."""
    def places(batches):
        for x in batches:
            p = np.unique(level.places(_longs(x.column("a")), _longs(x.column("b"))))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((p & np.uint64(63)).astype(np.int32))],
                                             ["word", "bit"])
    words = keys.mapInArrow(places, "word long, bit int").groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("w")).toArrow()
    level.words[words["word"].to_numpy()] = _longs(words["w"].combine_chunks())
    return level


def _kept(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for x in batches:
            yield x.filter(pa.array(shared.value.has(_longs(x.column("a")), _longs(x.column("b")))))
    return keys.mapInArrow(run, "a long, b long")


def cascade(universe: DataFrame, listed: list[str]) -> list[Level]:
    """Levels for the listed keys over ``universe (a, b)``, the hashes of all keys."""
    if not listed:
        return []
    if len(listed) > LISTED:
        raise ValueError(f"a list of {len(listed)} keys; at most {LISTED} are encoded")
    spark: SparkSession = universe.sparkSession
    own = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string").select(*_hashes("key"))
    inside = staged(universe.join(F.broadcast(own), ["a", "b"], "left_semi"), "listed")  # at most LISTED rows
    outside = universe.join(F.broadcast(own), ["a", "b"], "left_anti")
    n, total = inside.count(), universe.count()
    rate = min(0.5, 0.7071 * max(1, n) / max(1, total - n))
    levels, right, wrong = [], inside, outside
    while n:
        level = _filled(right, Level(n, rate if not levels else 0.5, len(levels)))
        levels.append(level)
        mistaken = staged(_kept(wrong, level), "mistaken")
        right, wrong, n = mistaken, right, mistaken.count()
    return levels


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: list[str] = (), default: str = "allow") -> DataFrame:
    """``pages (page_id, url, ...)``, rules ``(verdict, host, path)``, blocked hosts ->
    ``page_id, host, path, rule, verdict`` for every row.

    A rule fits its host and subdomains if the path starts with the rule's; the
    longest (host and path together, block before allow) wins.  Without one the
    verdict is ``block`` for a blocked host or its subdomains, else ``default``.
    Null urls and urls without ``://`` have an empty host and path and no rule;
    repeated rows are judged each; other columns are ignored."""
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    shape = lambda host, path: (host.count(".") + 1, len(path))
    by_rule, by_host = {shape(h, p) for _, h, p in rules}, {shape(h, "") for h in blocked}
    longest = max([n for _, n in by_rule], default=0)
    some = rows.select("host", F.substring("path", 1, longest).alias("path")).distinct()
    keyed = lambda shapes, tag: F.transform(keys_of(F.col("host"), F.col("path"), shapes), lambda k: F.concat(F.lit(tag), k))
    universe = staged(some.select(F.explode(F.concat(keyed(by_rule, "r"), keyed(by_host, "h"))).alias("key")).distinct()
                          .select(*_hashes("key")), "universe")
    lists = {v: cascade(universe, ["r" + h + p for w, h, p in rules if w == v]) for v in ("allow", "block")}
    lists["host"] = cascade(universe, ["h" + h for h in blocked])
    shared = pages.sparkSession.sparkContext.broadcast(lists)

    def run(batches):
        of = shared.value
        for x in batches:
            host, rule, verdict = x.column("host_keys"), [None] * x.num_rows, [None] * x.num_rows
            row = np.repeat(np.arange(x.num_rows), np.diff(host.offsets.to_numpy()))
            a, b = (_longs(x.column(c).flatten()) for c in ("host_a", "host_b"))
            hit = set(row[member(of["host"], a, b)].tolist())
            keys = x.column("rule_keys")
            row = np.repeat(np.arange(x.num_rows), np.diff(keys.offsets.to_numpy()))
            a, b = (_longs(x.column(c).flatten()) for c in ("rule_a", "rule_b"))
            block, text = member(of["block"], a, b), keys.flatten()
            for i in np.flatnonzero(block | member(of["allow"], a, b)).tolist():
                r, key = int(row[i]), text[i].as_py()[1:]
                if rule[r] is None or len(key) > len(rule[r]):
                    rule[r], verdict[r] = key, "block" if block[i] else "allow"
            verdict = [v or ("block" if r in hit else default) for r, v in enumerate(verdict)]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()),
                                              pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    hashed = lambda c, j: F.transform(c, lambda k: F.xxhash64(k) if j == 0 else F.xxhash64(F.lit(1), k))
    wide = rows.withColumn("rule_keys", keyed(by_rule, "r")).withColumn("host_keys", keyed(by_host, "h"))
    wide = wide.select(F.col("page_id").cast("long"), "host", "path", "rule_keys", hashed("rule_keys", 0).alias("rule_a"),
                       hashed("rule_keys", 1).alias("rule_b"), "host_keys", hashed("host_keys", 0).alias("host_a"),
                       hashed("host_keys", 1).alias("host_b"))
    return wide.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
